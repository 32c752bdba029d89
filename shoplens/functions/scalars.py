"""Column expressions used by more than one operator."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_sum(column: Column | str) -> Column:
    """Sum as decimals with nine digits after the point, so that the result does not depend on the order of addition."""
    column = F.col(column) if isinstance(column, str) else column
    return F.sum(column.cast("decimal(38,9)")).cast("double")


def exact_mean(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return exact_sum(column) / F.count(column)


def lookup(column: Column, mapping: Mapping, default=None) -> Column:
    """Value of a small literal mapping, with a default for keys it lacks."""
    picked = F.lit(default)
    for key, value in mapping.items():
        picked = F.when(column == F.lit(key), F.lit(value)).otherwise(picked)
    return picked


def guarded(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, and 0 where the denominator is not positive."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def full_days(later: Column, earlier: Column) -> Column:
    """Whole 24-hour spans between two timestamps (not calendar days)."""
    return F.floor((F.unix_timestamp(later) - F.unix_timestamp(earlier)) / F.lit(86400)).cast("long")


def stamp(column: Column | str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def weekday_flags(ts: Column) -> dict[str, Column]:
    hour, day = F.hour(ts), F.weekday(ts)
    return {
        "hour_of_day": hour,
        "day_of_week": day,
        "is_weekend": day.isin(5, 6),
        "is_business_hours": hour.between(9, 17),
        "is_evening": hour.between(17, 22),
        "is_morning": hour.between(6, 11),
    }


def price_tier(price: Column) -> Column:
    """Right-closed price bands; prices of 0 or less have no band."""
    return (
        F.when(price <= 0, F.lit(None).cast("string"))
        .when(price <= 50, "budget")
        .when(price <= 200, "affordable")
        .when(price <= 500, "mid-range")
        .when(price <= 1000, "premium")
        .when(price > 1000, "luxury")
    )


def dwell_band(seconds: Column) -> Column:
    return (
        F.when(seconds < 10, "very_short").when(seconds < 30, "short").when(seconds < 120, "medium")
        .when(seconds < 300, "long").when(seconds.isNotNull(), "very_long")
    )


def scroll_band(percent: Column) -> Column:
    return (
        F.when(percent < 25, "low").when(percent < 50, "medium").when(percent < 75, "high")
        .when(percent.isNotNull(), "very_high")
    )


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def unit(vector: Column) -> Column:
    """Vector divided by its length; a zero vector stays zero."""
    length = norm(vector)
    return F.transform(vector, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)))


def cosine(left: Column, right: Column) -> Column:
    size = norm(left) * norm(right)
    return F.when(size > 0, dot(left, right) / size).otherwise(F.lit(0.0))


def type_count(column: str, value: str) -> Column:
    return F.count_if(F.col(column) == F.lit(value))


def count_text(pairs: Column) -> Column:
    """'key:count' entries in key order as one string, from an array of (key, n) structs of an enumeration."""
    return F.array_join(
        F.transform(F.sort_array(pairs), lambda p: F.concat(p["k"].cast("string"), F.lit(":"), p["n"].cast("string"))), ","
    )
