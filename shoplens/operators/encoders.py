"""Label and ordinal codes, scaling, bins and flags. Fitted parameters are relations that can be stored and re-applied."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.functions.ordered import running
from shoplens.functions.scalars import lookup
from shoplens.schemas import AFFORDABLE_PRICE, DEVICES, FUNNEL, INCOME_CODE
from shoplens.session import shared_folder


def fit_labels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, code): position of every distinct value of each column in ascending order, missing as 'unknown'."""
    values = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit("unknown")).alias("value")) for c in columns])
        ).alias("e")
    ).select("e.*").distinct()
    return running(values, ["value"], {"n": F.lit(1)}, by=["column"]).select(
        "column", "value", (F.col("n") - 1).cast("long").alias("code")
    )


def apply_labels(df: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    known = labels.where(F.col("column") == column).select(F.col("value").alias("_value"), F.col("code").alias(f"{column}_encoded"))
    return df.join(known, F.coalesce(F.col(column), F.lit("unknown")) == F.col("_value"), "left").drop("_value")


def encode_labels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fits all columns in one pass and keeps the fitted labels in the shared folder, since every column reads them."""
    shared_folder(df.sparkSession)
    labels = fit_labels(df, columns).checkpoint()
    for column in columns:
        df = apply_labels(df, labels, column)
    return df


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with mean and population deviation of every column; zero deviation becomes 1."""
    parts = []
    for c in columns:
        deviation = F.stddev_pop(c)
        parts += [F.avg(c).alias(f"{c}_mean"), F.when(deviation > 0, deviation).otherwise(F.lit(1.0)).alias(f"{c}_scale")]
    return df.agg(*parts)


def apply_scaler(df: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    one = fitted.select(F.struct("*").alias("s")).scalar()
    with_fit = df.withColumn("_fit", one)
    return with_fit.withColumns(
        {f"{c}_scaled": (F.col(c) - F.col(f"_fit.{c}_mean")) / F.col(f"_fit.{c}_scale") for c in columns}
    ).drop("_fit")


def one_hot(events: DataFrame) -> DataFrame:
    flags = {f"event_type_{t}": (F.col("event_type") == t).cast("int") for t in FUNNEL}
    flags |= {f"device_{d}": (F.col("device_type") == d).cast("int") for d in DEVICES}
    return events.withColumns(flags)


def income_code(income: Column) -> Column:
    return F.coalesce(lookup(income, INCOME_CODE), F.lit(0.5))


def category_code(category: Column) -> Column:
    """A stable number in [0, 1) from the category's MD5."""
    return F.conv(F.substring(F.md5(category), 1, 7), 16, 10).cast("long") % 100 / F.lit(100.0)


def affordable(price: Column, income: Column) -> Column:
    return F.coalesce((price <= lookup(income, AFFORDABLE_PRICE)).cast("int"), F.lit(0))
