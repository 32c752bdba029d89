"""Profiles, funnels, scores, distributions and multi-level totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.functions.scalars import count_text, exact_mean, exact_sum, guarded, type_count
from shoplens.schemas import FUNNEL, FUNNEL_WEIGHTS


def interaction_profile(interactions: DataFrame, key: str, amount: str = "total_spent", ts: str = "ts") -> DataFrame:
    """Counts, ratings, amounts, dwell, scroll and first/last time per user or per product."""
    return interactions.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_interactions"),
        F.avg("rating").alias("avg_rating"),
        F.count("rating").alias("rating_count"),
        exact_sum("total_amount").alias(amount),
        exact_mean("total_amount").alias("avg_order_value"),
        F.avg("dwell_time").alias("avg_dwell_time"),
        F.sum("dwell_time").alias("total_dwell_time"),
        F.avg("scroll_depth").alias("avg_scroll_depth"),
        F.max("scroll_depth").alias("max_scroll_depth"),
        F.min(ts).alias("first_interaction"),
        F.max(ts).alias("last_interaction"),
    )


def session_profile(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("session_length"),
        F.countDistinct("product_id").alias("unique_products"),
        exact_sum("total_amount").alias("session_value"),
    )


def user_rates(profiled: DataFrame) -> DataFrame:
    """Per-day rates; less than one day counts as one."""
    days = F.greatest(F.col("days_since_created"), F.lit(1))
    ratings = F.col("rating_count")
    return profiled.withColumns(
        {
            "interaction_frequency": F.col("total_interactions") / days,
            "avg_rating_weighted": F.col("avg_rating") * ratings / F.greatest(ratings, F.lit(1)),
            "spending_power": F.col("total_spent") / days,
        }
    )


def popularity(n: Column, avg_rating: Column, rating_count: Column) -> Column:
    return F.lit(0.4) * n + F.lit(0.3) * avg_rating + F.lit(0.3) * rating_count


def engagement(avg_dwell: Column, avg_scroll: Column) -> Column:
    return F.lit(0.5) * avg_dwell + F.lit(0.5) * avg_scroll


def product_scores(profiled: DataFrame) -> DataFrame:
    return profiled.withColumns(
        {
            "popularity_score": popularity(F.col("total_interactions"), F.col("avg_rating"), F.col("rating_count")),
            "engagement_score": engagement(F.col("avg_dwell_time"), F.col("avg_scroll_depth")),
        }
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column)


def funnel_counts(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Views, clicks, cart additions and purchases in one pass."""
    return events.groupBy(*keys).agg(*[type_count("event_type", t).alias(f"{t}_count") for t in FUNNEL])


def funnel_rates(counts: DataFrame) -> DataFrame:
    view, click, cart, purchase = (F.col(f"{t}_count") for t in FUNNEL)
    return counts.withColumns(
        {
            "view_to_click_rate": guarded(click, view),
            "click_to_cart_rate": guarded(cart, click),
            "cart_to_purchase_rate": guarded(purchase, cart),
        }
    )


def weighted_engagement(counts: DataFrame) -> DataFrame:
    total = None
    for kind, weight in FUNNEL_WEIGHTS.items():
        part = F.col(f"{kind}_count") * F.lit(weight)
        total = part if total is None else total + part
    return counts.withColumn("user_engagement_score", total)


def audience(events: DataFrame, key: str | None = None, approximate: bool = False) -> DataFrame:
    """Distinct users per product, or distinct users and products overall. HyperLogLog form for streams."""
    distinct = (lambda c: F.approx_count_distinct(c, 0.02)) if approximate else F.countDistinct
    if key:
        return events.groupBy(key).agg(distinct("user_id").alias("unique_users"))
    return events.agg(distinct("user_id").alias("unique_users"), distinct("product_id").alias("unique_products"))


def distributions(events: DataFrame) -> DataFrame:
    """Event-type, device and hour counts as 'key:count' text, three rows. The domains are enumerations."""
    kinds = {"event_type": F.col("event_type"), "device_type": F.col("device_type"), "hour": F.format_string("%02d", F.hour("ts"))}
    long = events.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("distribution"), c.alias("k")) for n, c in kinds.items()])).alias("e")
    ).select("e.*")
    counted = long.groupBy("distribution", "k").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("distribution").agg(count_text(F.collect_list(F.struct("k", "n"))).alias("counts"))


def matrix_statistics(scores: DataFrame, n: Column) -> DataFrame:
    """Mean, max and non-zero count of an n x n matrix given only its stored entries."""
    cells = n * n
    return scores.agg(
        n.alias("items"),
        F.round(F.sum("score") / cells, 9).alias("mean_score"),
        F.greatest(F.max("score"), F.lit(0.0)).alias("max_score"),
        F.count_if(F.col("score") != 0).alias("non_zero"),
    )


def rollups(events: DataFrame) -> DataFrame:
    """Per-user, per-product and global totals from one scan."""
    pairs = events.groupBy("user_id", "product_id").agg(
        F.count(F.lit(1)).alias("n"), type_count("event_type", "purchase").alias("purchases"),
        exact_sum("dwell_time").alias("dwell"),
    )
    level = F.when(F.grouping("user_id") == 0, "user").when(F.grouping("product_id") == 0, "product").otherwise("global")
    return pairs.groupingSets([["user_id"], ["product_id"], []], "user_id", "product_id").agg(
        level.alias("level"), F.sum("n").alias("events"), F.sum("purchases").alias("purchases"),
        exact_sum("dwell").alias("dwell_time"),
    )
