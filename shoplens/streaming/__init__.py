"""Structured Streaming jobs; the stateless parts are shared with the batch operators."""
