"""Feature statistics, quality checks against a rule catalogue, and drift between two samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoplens.functions.ordered import exact_quantiles, running
from shoplens.operators.ordering import first_rows

CATEGORY_NAMES = [
    "Electronics", "Clothing", "Books", "Home & Garden", "Sports & Outdoors", "Beauty & Health", "Toys & Games", "Automotive",
]
# fixed values: (feature, group, type, lowest, highest, valid values, null policy)
CATALOGUE = [
    ("user_age", "user", "int64", 13.0, 100.0, None, "median age"),
    ("user_income_level", "user", "string", None, None, ["low", "medium", "high"], "medium"),
    ("user_preference_category", "user", "string", None, None, CATEGORY_NAMES, "most common category"),
    ("item_price", "item", "float64", 0.01, 10000.0, None, "category median price"),
    ("item_rating", "item", "float64", 1.0, 5.0, None, "category average rating"),
    ("item_category", "item", "string", None, None, CATEGORY_NAMES, "Other"),
    ("hour_of_day", "contextual", "int64", 0.0, 23.0, None, "current time"),
    ("day_of_week", "contextual", "int64", 0.0, 6.0, None, "current time"),
    ("is_weekend", "contextual", "bool", None, None, ["true", "false"], "current time"),
    ("session_duration_minutes", "contextual", "float64", 0.0, 1440.0, None, "0"),
    ("user_total_interactions", "interaction", "int64", 0.0, 100000.0, None, "0"),
    ("user_recent_category_counts", "interaction", "json", None, None, None, "empty object"),
    ("user_avg_session_duration", "interaction", "float64", 0.0, 1440.0, None, "global average"),
]
CATALOGUE_SCHEMA = "feature string, grp string, type string, low double, high double, allowed array<string>, null_policy string"
TYPE_NAMES = {"tinyint": "int64", "smallint": "int64", "int": "int64", "bigint": "int64", "float": "float64", "double": "float64", "boolean": "bool"}
NULL_WARNING_PCT, NULL_FAILURE_PCT = 10.0, 50.0
PSI_BINS, PSI_FLOOR, PSI_WARNING, PSI_CRITICAL, KS_CRITICAL = 10, 1e-4, 0.1, 0.25, 0.1


def catalogue(spark, rows: Sequence[tuple] = tuple(CATALOGUE)) -> DataFrame:
    return spark.createDataFrame(list(rows), CATALOGUE_SCHEMA)


def long_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value) rows of the numeric columns."""
    return df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("e")
    ).select("e.*")


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts, moments and exact quartiles of every column in two passes over (feature, value) rows.

    Skewness and excess kurtosis are bias-corrected, which the built-in ones are not.
    """
    long = long_numbers(df, columns)
    n = F.col("n").cast("double")
    basic = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("null_count"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2"),
    )
    shape = basic.withColumns(
        {
            "null_pct": F.col("null_count") / F.col("rows") * F.lit(100.0),
            "skewness": F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)),
            "kurtosis": F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)),
        }
    ).drop("g1", "g2")
    quartiles = exact_quantiles(long, "value", {"q25": 0.25, "median": 0.5, "q75": 0.75}, by=["feature"]).drop("n_values")
    return shape.join(quartiles, "feature", "left")


def categorical_profile(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """Distinct values, mode and the k most frequent values of every column, one row per listed value."""
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])).alias("e")
    ).select("e.*").where(F.col("value").isNotNull())
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    summary = counts.groupBy("feature").agg(
        F.count(F.lit(1)).alias("distinct_values"), F.sum("n").alias("total"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"), F.max("n").alias("mode_count"),
    )
    top = first_rows(counts, ["feature"], [F.col("n").desc(), F.col("value")], k)
    return top.join(summary, "feature")


def long_features(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """(feature, type, number, text) rows; ``columns`` maps a feature name to the column that holds it."""
    kinds = dict(df.dtypes)
    parts = []
    for feature, column in columns.items():
        kind = TYPE_NAMES.get(kinds[column], "json" if kinds[column].startswith("map") else "string")
        number = F.col(column).cast("double") if kind in ("int64", "float64") else F.lit(None).cast("double")
        text = F.to_json(column) if kind == "json" else F.col(column).cast("string")
        parts.append(F.struct(F.lit(feature).alias("feature"), F.lit(kind).alias("actual"), number.alias("number"), text.alias("text")))
    return df.select(F.explode(F.array(*parts)).alias("e")).select("e.*")


def quality_checks(long: DataFrame, rules: DataFrame) -> DataFrame:
    """Type, range, value and null checks of every feature in one pass; worst status first: failed, warning, passed.

    The rules are a literal relation of a dozen rows.
    """
    joined = long.join(F.broadcast(rules.select("feature", "type", "low", "high", "allowed")), "feature")
    outside = (F.col("number") < F.col("low")) | (F.col("number") > F.col("high"))
    foreign = F.col("allowed").isNotNull() & F.col("text").isNotNull() & ~F.array_contains("allowed", F.col("text"))
    counted = joined.groupBy("feature").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("text").isNull()).alias("null_count"), F.count_if(outside).alias("out_of_range"),
        F.countDistinct(F.when(foreign, F.col("text"))).alias("invalid_values"), F.min(F.col("type") == F.col("actual")).alias("type_ok"),
    )
    null_pct = F.col("null_count") / F.col("rows") * F.lit(100.0)
    checks = counted.withColumns(
        {
            "out_of_range_pct": F.col("out_of_range") / F.col("rows") * F.lit(100.0), "null_pct": null_pct,
            "type_status": F.when(F.col("type_ok"), "passed").otherwise("failed"),
            "range_status": F.when(F.col("out_of_range") == 0, "passed").otherwise("warning"),
            "values_status": F.when(F.col("invalid_values") == 0, "passed").otherwise("warning"),
            "null_status": F.when(null_pct < NULL_WARNING_PCT, "passed").when(null_pct < NULL_FAILURE_PCT, "warning").otherwise("failed"),
        }
    ).drop("type_ok")
    every = F.array("type_status", "range_status", "values_status", "null_status")
    return checks.withColumn(
        "overall_status",
        F.when(F.array_contains(every, "failed"), "failed").when(F.array_contains(every, "warning"), "warning").otherwise("passed"),
    )


def catalogue_summary(rules: DataFrame) -> DataFrame:
    return rules.groupBy("grp").agg(
        F.count(F.lit(1)).alias("features"), F.count_if(F.col("low").isNotNull()).alias("with_range"),
        F.count_if(F.col("allowed").isNotNull()).alias("with_values"),
    )


def stability_index(expected: DataFrame, actual: DataFrame, features: Sequence[str], bins: int = PSI_BINS) -> DataFrame:
    """Population stability index per feature over the expected sample's quantile bins."""
    cuts = {f"c{i}": i / bins for i in range(1, bins)}
    samples = long_numbers(expected, features).where("value IS NOT NULL").withColumn("is_actual", F.lit(0)).unionByName(
        long_numbers(actual, features).where("value IS NOT NULL").withColumn("is_actual", F.lit(1))
    )
    edges = exact_quantiles(samples.where("is_actual = 0"), "value", cuts, by=["feature"]).drop("n_values")
    placed = samples.join(F.broadcast(edges), "feature")  # one row per feature
    bin_no = sum((F.col("value") > F.col(c)).cast("int") for c in cuts)
    counts = placed.groupBy("feature", bin_no.alias("bin")).agg(
        F.count_if(F.col("is_actual") == 0).alias("e"), F.count_if(F.col("is_actual") == 1).alias("a")
    )
    whole = W.partitionBy("feature")
    shares = counts.select(
        "feature", F.greatest(F.col("e") / F.sum("e").over(whole), F.lit(PSI_FLOOR)).alias("e"),
        F.greatest(F.col("a") / F.sum("a").over(whole), F.lit(PSI_FLOOR)).alias("a"),
    )
    return shares.groupBy("feature").agg(F.sum((F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e"))).alias("psi"))


def largest_gap(expected: DataFrame, actual: DataFrame, features: Sequence[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic per feature; the distribution functions are summed over ranges."""
    both = long_numbers(expected, features).withColumn("e", F.lit(1)).withColumn("a", F.lit(0)).unionByName(
        long_numbers(actual, features).withColumn("e", F.lit(0)).withColumn("a", F.lit(1))
    ).where("value IS NOT NULL")
    counts = both.groupBy("feature", "value").agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    summed = running(counts, ["value"], {"ce": F.col("e"), "ca": F.col("a")}, by=["feature"], totals=True)
    return summed.groupBy("feature").agg(F.max(F.abs(F.col("ce") / F.col("ce_total") - F.col("ca") / F.col("ca_total"))).alias("ks"))


def drift_alerts(psi: DataFrame, ks: DataFrame) -> DataFrame:
    severity: Column = (
        F.when((F.col("psi") > PSI_CRITICAL) | (F.col("ks") > KS_CRITICAL), "critical").when(F.col("psi") > PSI_WARNING, "warning").otherwise("none")
    )
    return psi.join(ks, "feature").withColumn("severity", severity)
