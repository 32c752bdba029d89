"""Clickstream features. Row-wise parts (enrich, event_scores) and grouped parts written as plain aggregates serve
batch and stream alike; sessions and running means also have batch forms that never hold one user's events together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoplens.functions.ordered import running
from shoplens.functions.scalars import dwell_band, exact_sum, lookup, scroll_band, type_count, weekday_flags
from shoplens.operators.aggregates import distributions
from shoplens.operators.encoders import one_hot
from shoplens.schemas import DEVICES, FUNNEL, FUNNEL_WEIGHTS

# fixed values
SESSION_GAP_MINUTES, PRODUCT_WINDOW, GLOBAL_WINDOW, GLOBAL_SLIDE = 30, "60 minutes", "120 minutes", "30 minutes"
LONG_DWELL_SECONDS = 300.0


def enrich(events: DataFrame) -> DataFrame:
    """Flags, clock features and bands; a dwell time or scroll depth of zero counts as absent."""
    flags = weekday_flags(F.col("ts"))
    dwell, scroll = (F.when(F.col(c) != 0, F.col(c)) for c in ("dwell_time", "scroll_depth"))
    return one_hot(events).withColumns(
        {
            "hour_of_day": flags["hour_of_day"], "day_of_week": flags["day_of_week"],
            "is_weekend": flags["is_weekend"].cast("int"), "is_business_hours": flags["is_business_hours"].cast("int"),
            "dwell_time_seconds": dwell, "dwell_time_category": dwell_band(dwell),
            "scroll_depth_percentage": scroll, "scroll_depth_category": scroll_band(scroll),
        }
    )


def event_engagement() -> Column:
    dwell, scroll = F.coalesce("dwell_time", F.lit(0.0)), F.coalesce("scroll_depth", F.lit(0.0))
    score = (
        F.when(dwell > 0, F.least(dwell / F.lit(LONG_DWELL_SECONDS), F.lit(1.0)) * F.lit(0.4)).otherwise(F.lit(0.0))
        + F.when(scroll > 0, scroll / F.lit(100.0) * F.lit(0.3)).otherwise(F.lit(0.0))
        + F.when(F.col("event_type") == "purchase", F.lit(0.3)).otherwise(F.lit(0.0))
    )
    return F.least(score, F.lit(1.0))


def event_popularity() -> Column:
    return F.least(F.coalesce(lookup(F.col("event_type"), FUNNEL_WEIGHTS), F.lit(0.0)), F.lit(1.0))


def event_scores(events: DataFrame) -> DataFrame:
    return events.withColumns({"engagement_score": event_engagement(), "popularity_score": event_popularity()})


def totals() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_events"), *[type_count("event_type", t).alias(f"{t}_count") for t in FUNNEL],
        exact_sum("dwell_time").alias("total_dwell_time"), exact_sum("scroll_depth").alias("total_scroll_depth"),
        F.max("ts").alias("last_activity"),
    ]


def user_totals(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(*totals())


def product_totals(events: DataFrame) -> DataFrame:
    return events.groupBy("product_id").agg(*totals(), F.countDistinct("user_id").alias("unique_users"))


def global_totals(events: DataFrame) -> DataFrame:
    """One row: events, users, products, last activity and the three distributions."""
    counts = events.agg(
        F.count(F.lit(1)).alias("total_events"), F.countDistinct("user_id").alias("unique_users"),
        F.countDistinct("product_id").alias("unique_products"), F.max("ts").alias("last_activity"),
    )
    spread = distributions(events).agg(F.map_from_entries(F.collect_list(F.struct("distribution", "counts"))).alias("d")).scalar()
    return counts.withColumn("_d", spread).select(
        "*", *[F.element_at("_d", k).alias(f"{k}_distribution") for k in ("event_type", "device_type", "hour")]
    ).drop("_d")


def sessions(events: DataFrame, gap_minutes: int = SESSION_GAP_MINUTES) -> DataFrame:
    """Sessions per user: a pause longer than the gap starts a new one.

    Events are first summed per user and minute, in every task, which cannot cross a session border. What is then
    ordered per user is at most one row per minute of history, however many events a user has.
    """
    minutes = events.groupBy("user_id", F.date_trunc("minute", "ts").alias("minute")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("events"),
        type_count("event_type", "purchase").alias("purchases"), exact_sum("dwell_time").alias("dwell"),
    )
    w = W.partitionBy("user_id").orderBy("minute")
    pause = F.unix_micros("first") - F.unix_micros(F.lag("last").over(w))
    starts = minutes.withColumn("_new", F.when(pause.isNull() | (pause > gap_minutes * 60_000_000), 1).otherwise(0))
    numbered = starts.withColumn("session_no", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session_no").agg(
        F.min("first").alias("session_start"), F.max("last").alias("session_end"), F.sum("events").alias("events"),
        F.sum("purchases").alias("purchases"), exact_sum("dwell").alias("dwell_time"),
    )


def session_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("session_count"))


def duration_minutes() -> Column:
    return (F.unix_micros("session_end") - F.unix_micros("session_start")) / F.lit(60_000_000.0)


def session_durations(found: DataFrame, users: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Mean session length per user over the last days; users without one get the mean of all sessions."""
    recent = found.where(F.col("session_start") > as_of - F.expr(f"INTERVAL {int(days)} DAYS")).withColumn("minutes", duration_minutes())
    overall = recent.agg(F.avg("minutes").alias("m")).scalar()
    own = recent.groupBy("user_id").agg(F.avg("minutes").alias("m"))
    return users.select("user_id").distinct().join(own, "user_id", "left").select(
        "user_id", F.coalesce("m", overall).alias("avg_session_duration")
    )


def product_windows(events: DataFrame, width: str = PRODUCT_WINDOW) -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w"), "product_id").agg(*totals()).select(
        F.col("w.start").alias("window_start"), "*"
    ).drop("w")


def global_windows(events: DataFrame, width: str = GLOBAL_WINDOW, slide: str = GLOBAL_SLIDE) -> DataFrame:
    return events.groupBy(F.window("ts", width, slide).alias("w")).agg(*totals()).select(
        F.col("w.start").alias("window_start"), "*"
    ).drop("w")


def upsert_latest(stored: DataFrame, changes: DataFrame, key: str, ts: str = "last_activity") -> DataFrame:
    """Stored rows and changes reduced to the newest row per key."""
    rest = [c for c in stored.columns if c != key]
    both = stored.unionByName(changes.select(*stored.columns))
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*[F.col(ts), *[F.col(c) for c in rest if c != ts]])).alias("r")).select(key, "r.*")


def user_rows(events: DataFrame) -> DataFrame:
    """The row an event writes to the user feature table."""
    return event_scores(events).select(
        "user_id", F.col("ts").alias("last_activity"), "event_id", F.col("event_type").alias("last_event_type"),
        F.col("device_type").alias("last_device"), "engagement_score",
    )


def running_means(events: DataFrame, columns: tuple[str, ...] = ("dwell_time", "scroll_depth"), key: str = "user_id", before: DataFrame | None = None) -> DataFrame:
    """Final value of the online mean ((avg * (n - 1)) + x) / n over a key's views, n counting every view.

    Every view is an affine map of the mean. Composed, they keep x_i with weight 1/n_i times the product of (n_j - 1) / n_j over
    the later views that have one (a view without x advances n and leaves the mean), and the mean ``before`` (key,
    total_views, avg_*), with which a stream goes on, with the product over all of them. The logarithms of that product are
    summed over ranges; no key's views are folded in one task.
    """
    views = events.where(F.col("event_type") == "view").select(key, "ts", "event_id", *columns)
    numbered = running(views, ["ts", "event_id"], {"_no": F.lit(1)}, by=[key])
    if before is None:
        numbered = numbered.withColumns({"_earlier": F.lit(0), **{f"_mean_{c}": F.lit(0.0) for c in columns}})
    else:
        known = before.select(F.col(key).alias("_key"), F.col("total_views").alias("_earlier"), *[F.col(f"avg_{c}").alias(f"_mean_{c}") for c in columns])
        numbered = numbered.join(known, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key").fillna(0, ["_earlier", *[f"_mean_{c}" for c in columns]])
    n = F.col("_no") + F.col("_earlier")
    has = {c: F.col(c).isNotNull() & (F.col(c) != 0) for c in columns}
    shrink = {f"l_{c}": F.when(has[c] & (n > 1), F.log((n - 1) / n)).otherwise(F.lit(0.0)) for c in columns}
    weighed = running(numbered, ["ts", "event_id"], shrink, by=[key], totals=True)
    own = {c: F.sum(F.when(has[c], F.col(c) / n * F.exp(F.col(f"l_{c}_total") - F.col(f"l_{c}")))) for c in columns}
    carried = {c: F.max(F.col(f"_mean_{c}") * F.exp(f"l_{c}_total")) for c in columns}
    means = [(F.coalesce(own[c], F.lit(0.0)) + carried[c]).alias(f"avg_{c}") for c in columns]
    return weighed.groupBy(key).agg(F.max(n).cast("long").alias("total_views"), *means)


def device_preferences(events: DataFrame) -> DataFrame:
    device = F.coalesce("device_type", F.lit("desktop"))
    return events.groupBy("user_id").agg(*[F.count_if(device == d).alias(f"device_preference_{d}") for d in DEVICES])


def location_preferences(events: DataFrame) -> DataFrame:
    """Events per user and location, one row each."""
    return events.groupBy("user_id", F.coalesce("location", F.lit("Unknown")).alias("location")).agg(F.count(F.lit(1)).alias("n"))


def live_state(state: DataFrame, as_of: Column, days: int, ts: str = "last_activity") -> DataFrame:
    """State not touched for ``days`` has expired."""
    return state.where(F.col(ts) > as_of - F.expr(f"INTERVAL {int(days)} DAYS"))
