"""Feature tables: rows with a storage and an expiry time instead of a key/value store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoplens.functions.ordered import carry_forward, exact_quantiles
from shoplens.functions.scalars import count_text, exact_mean, price_tier, type_count
from shoplens.operators import clickstream as C
from shoplens.operators.aggregates import funnel_counts, funnel_rates, weighted_engagement
from shoplens.operators.ordering import first_rows
from shoplens.schemas import FUNNEL_WEIGHTS, PRODUCT_TTL_SECONDS, USER_TTL_SECONDS

TTL = {"user": USER_TTL_SECONDS, "product": PRODUCT_TTL_SECONDS}


def feature_map(columns: list[str]) -> Column:
    return F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])


def stored(df: DataFrame, entity: str, key: str, columns: list[str], stored_at: Column, version: str = "v1") -> DataFrame:
    """Rows to append: features as a map, storage time, expiry by the entity's time to live."""
    return df.select(
        F.lit(entity).alias("entity_type"), F.col(key).alias("entity_id"), feature_map(columns).alias("features"),
        stored_at.alias("stored_at"), (stored_at + F.make_dt_interval(secs=F.lit(float(TTL[entity])))).alias("expires_at"),
        F.lit(version).alias("version"),
    )


def live(table: DataFrame, as_of: Column) -> DataFrame:
    """The newest unexpired row per entity. A row expiring exactly at ``as_of`` is gone."""
    rest = [c for c in table.columns if c not in ("entity_type", "entity_id")]
    return table.where((F.col("stored_at") <= as_of) & (F.col("expires_at") > as_of)).groupBy("entity_type", "entity_id").agg(
        F.max_by(F.struct(*rest), F.struct("stored_at", "version")).alias("r")
    ).select("entity_type", "entity_id", "r.*")


def lookup_ids(table: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """Wanted (entity_type, entity_id) rows with their live features, null where there are none."""
    return ids.join(live(table, as_of), ["entity_type", "entity_id"], "left")


def patch(table: DataFrame, patches: DataFrame, as_of: Column) -> DataFrame:
    """Patches (entity_type, entity_id, changes map) merged into live rows; expiry is kept, dead rows stay dead."""
    changed = live(table, as_of).join(patches, ["entity_type", "entity_id"])
    kept = F.map_filter("features", lambda k, v: ~F.map_contains_key(F.col("changes"), k))
    return changed.withColumn("features", F.map_concat(kept, F.col("changes"))).drop("changes")


def statistics(table: DataFrame, as_of: Column) -> DataFrame:
    return table.groupBy("entity_type").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("entity_id").alias("entities"), F.count_if(F.col("expires_at") > as_of).alias("live_rows")
    )


def expired_counts(table: DataFrame, as_of: Column) -> DataFrame:
    return table.groupBy("entity_type").agg(
        F.count_if(F.col("expires_at") <= as_of).alias("removed"), F.count_if(F.col("expires_at") > as_of).alias("kept")
    )


def without_expired(table: DataFrame, as_of: Column) -> DataFrame:
    return table.where(F.col("expires_at") > as_of)


def online_user_features(events: DataFrame) -> DataFrame:
    """Counts, running means, sessions and device preferences per user."""
    counts = funnel_counts(events, ["user_id"]).select(
        "user_id", F.col("view_count").alias("total_views"), F.col("click_count").alias("total_clicks"),
        F.col("add_to_cart_count").alias("total_adds_to_cart"), F.col("purchase_count").alias("total_purchases"),
    )
    means = C.running_means(events).drop("total_views")
    found = C.sessions(events).groupBy("user_id").agg(F.count(F.lit(1)).alias("session_count"), F.avg(C.duration_minutes()).alias("avg_session_duration"))
    return counts.join(means, "user_id", "left").join(found, "user_id", "left").join(C.device_preferences(events), "user_id", "left").fillna(0)


def online_product_features(events: DataFrame) -> DataFrame:
    counted = weighted_engagement(funnel_rates(funnel_counts(events, ["product_id"])))
    means = C.running_means(events, key="product_id").drop("total_views")
    renamed = counted.withColumnsRenamed(
        {"view_count": "total_views", "click_count": "total_clicks", "add_to_cart_count": "total_adds_to_cart", "purchase_count": "total_purchases"}
    )
    return renamed.join(means, "product_id", "left").fillna(0.0)


def as_of_features(facts: DataFrame, features: DataFrame, key: str, fact_ts: str, feature_ts: str, value: str, fact_id: str) -> DataFrame:
    """The newest ``value`` at or before each fact's time. ``fact_id`` must be unique; a feature at the same instant counts."""
    left = facts.select(key, F.col(fact_ts).alias("_ts"), F.lit(1).alias("_kind"), F.col(fact_id).alias("_id"), F.lit(None).cast(features.schema[value].dataType).alias(value))
    # several feature rows at one instant are one: the largest value
    right = features.groupBy(key, F.col(feature_ts).alias("_ts")).agg(F.max(value).alias(value)).select(
        key, "_ts", F.lit(0).alias("_kind"), F.lit(0).cast(facts.schema[fact_id].dataType).alias("_id"), value
    )
    filled = carry_forward(left.unionByName(right), [key], ["_ts", "_kind", "_id"], value, f"{value}_as_of")
    return filled.where(F.col("_kind") == 1).select(F.col("_id").alias(fact_id), key, F.col("_ts").alias(fact_ts), f"{value}_as_of")


def recent_categories(interactions: DataFrame, products: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Category counts of the last days per user as 'category:count' text."""
    recent = interactions.where(F.col("ts") > as_of - F.expr(f"INTERVAL {int(days)} DAYS"))
    counted = _category_counts(recent, products)
    return counted.groupBy("user_id").agg(count_text(F.collect_list(F.struct(F.col("category").alias("k"), "n"))).alias("recent_category_counts"))


def _category_counts(interactions: DataFrame, products: DataFrame) -> DataFrame:
    pairs = interactions.groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(products.select("product_id", "category"), "product_id").groupBy("user_id", "category").agg(F.sum("n").alias("n"))


def preferred_category(interactions: DataFrame, products: DataFrame) -> DataFrame:
    best = first_rows(_category_counts(interactions, products), ["user_id"], [F.col("n").desc(), F.col("category")], 1)
    return best.select("user_id", F.col("category").alias("preferred_category"))


def filled_items(products: DataFrame, interactions: DataFrame) -> DataFrame:
    """Rating as the mean of user ratings, else the category's mean; missing prices become the category's median."""
    rated = interactions.where(F.col("rating").isNotNull()).groupBy("product_id").agg(F.avg("rating").alias("item_rating"))
    known = products.join(rated, "product_id", "left")
    means = known.groupBy("category").agg(F.avg("item_rating").alias("category_rating"))
    medians = exact_quantiles(products, "price", {"category_price": 0.5}, by=["category"]).drop("n_values")
    return known.join(means, "category", "left").join(medians, "category", "left").select(
        "product_id", "category", F.coalesce("item_rating", "category_rating").alias("item_rating"),
        F.coalesce("price", "category_price").alias("price"),
    )


def activity(events: DataFrame, as_of: Column) -> DataFrame:
    """Hours since the last event, purchases per view, last week's weighted events over the week before."""
    weight = F.lit(0.0)
    for kind, w in FUNNEL_WEIGHTS.items():
        weight = F.when(F.col("event_type") == kind, F.lit(w)).otherwise(weight)
    tenths = (weight * 10).cast("long")
    age = (F.unix_timestamp(as_of) - F.unix_timestamp("ts")) / F.lit(86400.0)
    out = events.groupBy("product_id").agg(
        F.max("ts").alias("_last"), type_count("event_type", "purchase").alias("_p"), type_count("event_type", "view").alias("_v"),
        F.sum(F.when(age.between(0, 7), tenths).otherwise(0)).alias("_new"), F.sum(F.when((age > 7) & (age <= 14), tenths).otherwise(0)).alias("_old"),
    )
    return out.select(
        "product_id", ((F.unix_timestamp(as_of) - F.unix_timestamp("_last")) / F.lit(3600.0)).alias("activity_recency_hours"),
        F.when(F.col("_v") > 0, F.col("_p") / F.col("_v")).otherwise(F.lit(0.0)).alias("conversion_rate"),
        F.when(F.col("_old") > 0, F.col("_new") / F.col("_old")).otherwise(F.lit(0.0)).alias("trending_score"),
    )


def price_sensitivity(interactions: DataFrame, products: DataFrame) -> DataFrame:
    """Mean price of a user's products over the mean price of the catalogue."""
    catalogue = products.agg(exact_mean("price").alias("m")).scalar()
    pairs = interactions.groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("n")).join(products.select("product_id", "price"), "product_id")
    mean = F.sum(F.col("price").cast("decimal(18,2)") * F.col("n")).cast("double") / F.sum("n")
    return pairs.groupBy("user_id").agg(mean.alias("m")).select("user_id", (F.col("m") / catalogue).alias("price_sensitivity"))


def season_and_share(interactions: DataFrame, products: DataFrame) -> DataFrame:
    """Per product: price tier, share of the category's events, and the busiest month against the mean month."""
    monthly = interactions.groupBy("product_id", F.month("ts").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    busiest = monthly.groupBy("product_id").agg(F.sum("n").alias("n"), (F.max("n") / (F.sum("n") / F.lit(12.0))).alias("seasonal_trend"))
    known = products.select("product_id", "category", "price").join(busiest, "product_id", "left").fillna(0, subset=["n", "seasonal_trend"])
    shares = known.groupBy(F.col("category").alias("_category")).agg(F.sum("n").alias("category_n"))
    return known.join(shares, F.col("category").eqNullSafe(F.col("_category"))).select(
        "product_id", price_tier(F.col("price")).alias("price_tier"), "seasonal_trend", (F.col("n") / F.col("category_n")).alias("category_popularity")
    )
