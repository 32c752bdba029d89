"""Recommendation analytics on PySpark: every capability is a function from DataFrames to a DataFrame."""
