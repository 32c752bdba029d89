"""Windowed, de-duplicated, joined and stateful features over an event stream. Grouped features reuse the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.functions.scalars import exact_sum, type_count
from shoplens.operators.clickstream import (
    GLOBAL_SLIDE, GLOBAL_WINDOW, PRODUCT_WINDOW, SESSION_GAP_MINUTES, global_windows, live_state, product_windows, running_means,
)
from shoplens.schemas import STATE_TTL_DAYS
from shoplens.streaming.keyed import BUCKETS, BucketTable

LATENESS = "10 minutes"


def watermarked(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    return events.withWatermark("ts", lateness)


def distinct_events(events: DataFrame) -> DataFrame:
    """One row per event id; ids are remembered as long as the watermark allows repeats."""
    return events.dropDuplicatesWithinWatermark(["event_id"])


def user_sessions(events: DataFrame, gap_minutes: int = SESSION_GAP_MINUTES) -> DataFrame:
    """Sessions per user, emitted when the watermark passes their end in append mode. As in batch, only a pause longer than
    the gap ends a session; the window itself would end at the gap."""
    return events.groupBy("user_id", F.session_window("ts", f"{gap_minutes} minutes 1 microsecond").alias("w")).agg(
        F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count(F.lit(1)).alias("events"),
        type_count("event_type", "purchase").alias("purchases"), exact_sum("dwell_time").alias("dwell_time"),
    ).drop("w")


def hourly_products(events: DataFrame) -> DataFrame:
    return product_windows(events, PRODUCT_WINDOW)


def sliding_totals(events: DataFrame) -> DataFrame:
    return global_windows(events, GLOBAL_WINDOW, GLOBAL_SLIDE)


def with_attributes(events: DataFrame, users: DataFrame, products: DataFrame) -> DataFrame:
    """Stream-static left joins; Catalyst broadcasts a static side when its size allows."""
    return events.join(users, "user_id", "left").join(products, "product_id", "left")


MEANS = T.StructType(
    [
        T.StructField("user_id", T.LongType()), T.StructField("total_views", T.LongType()), T.StructField("avg_dwell_time", T.DoubleType()),
        T.StructField("avg_scroll_depth", T.DoubleType()), T.StructField("last_activity", T.TimestampType()),
    ]
)


def means_table(folder: str, buckets: int = BUCKETS) -> BucketTable:
    """Per user (views, mean dwell, mean scroll) as a keyed table: the handler of a stream of events.

    The views of a batch are composed into one map per user by ``running_means``, ordered over ranges, so that a user with
    a third of them is spread over a third of the tasks; the table then holds three numbers per user. A user without views
    for STATE_TTL_DAYS before the batch's first view starts anew. Events of a user must not come before earlier batches'.
    """

    def views(events: DataFrame) -> DataFrame:
        return events.where(F.col("event_type") == "view").select("user_id", "event_type", "ts", "event_id", "dwell_time", "scroll_depth")

    def merge(stored: DataFrame, changes: DataFrame) -> DataFrame:
        oldest = changes.agg(F.min("ts").alias("m")).scalar()
        live = live_state(stored, oldest, STATE_TTL_DAYS)
        seen = changes.groupBy("user_id").agg(F.max("ts").alias("last_activity"))
        same = lambda a, b: a["user_id"].eqNullSafe(b["_user"])
        renamed = seen.withColumnRenamed("user_id", "_user")
        means = running_means(changes, before=live)
        new = means.join(renamed, same(means, renamed)).drop("_user")
        return new.unionByName(live.join(renamed.select("_user"), same(live, renamed), "left_anti"))

    return BucketTable(folder, "user_id", MEANS, views, merge, buckets)
