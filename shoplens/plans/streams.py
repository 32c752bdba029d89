"""Streaming queries: each runs its stream over the supplied events to the end and returns the table it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens import schemas
from shoplens.functions.scalars import exact_sum, stamp
from shoplens.operators import clickstream as C
from shoplens.operators import monitor as M
from shoplens.plans.aggregates import DISTRIBUTIONS
from shoplens.plans.clickstream import ENGAGEMENT, ENRICHED, ENRICHED_COLUMNS, FOLD, LATEST, SESSIONS, STAMP, TOTALS, stamped
from shoplens.plans.registry import query
from shoplens.sources.sinks import run_folder
from shoplens.sources.tables import as_clickstream
from shoplens.streaming import features as S
from shoplens.streaming import sinks, sources
from shoplens.streaming.keyed import SKETCH_BOUND, BucketTable, MergedTable, finished_totals, merge_totals, partial_totals

EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("product_id", T.LongType()),
        T.StructField("event_type", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("dwell_time", T.DoubleType()),
        T.StructField("scroll_depth", T.DoubleType()), T.StructField("device_type", T.StringType()), T.StructField("location", T.StringType()),
    ]
)
COLUMNS = "event_id, user_id, product_id, event_type, ts, dwell_time, device_type"
PLAIN = f"SELECT {COLUMNS.replace('ts,', STAMP.format('ts') + ' AS ts,')} FROM clickstream"


def stream(shop):
    """The events as a stream in the clickstream's form."""
    return as_clickstream(sources.parquet_events(shop.spark, f"{shop.folder}/events*.parquet", schemas.SUPPLIED["events"]))


def in_files(shop, files: int = 10):
    """The same stream from several files, one per batch."""
    folder = run_folder(shop.spark, "files")
    events = shop.table("events")
    events.repartition(files).write.parquet(folder)
    return as_clickstream(sources.parquet_events(shop.spark, folder, events.schema, max_files=1))


def plain(df):
    return stamped(df.select(*COLUMNS.split(", ")), "ts")


# Files of a topic: their number and their size both grow with the square root of the events.
FILES = "CAST(ceil(sqrt(count(*)) / 25e0) AS INT)"


def topic(shop) -> str:
    """The events as a topic of keyed JSON records in several files."""
    folder = run_folder(shop.spark, "topic")
    files = shop.clickstream.agg(F.ceil(F.sqrt(F.count(F.lit(1)).cast("double")) / 25.0)).first()[0]
    sources.encode(shop.clickstream, "event_id").repartition(max(1, files)).write.json(folder)
    return folder


@query("a7_event_source", "clickstream", PLAIN)
def _(shop):
    folder = run_folder(shop.spark, "source")
    sinks.append_table(sources.decode(sources.file_records(shop.spark, topic(shop)), EVENT).drop("key", sources.CORRUPT), folder)
    return plain(sinks.appended(shop.spark, folder))


@query("a8_bounded_consume", "clickstream", f"SELECT count(*) AS rows, {FILES} AS batches, count(DISTINCT event_id) AS events FROM clickstream")
def _(shop):
    folder = run_folder(shop.spark, "bounded")
    records = sources.file_records(shop.spark, topic(shop), max_files=1)
    sinks.append_table(sources.decode(records, EVENT), folder)
    return shop.spark.read.parquet(f"{folder}/data").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("batch").cast("int").alias("batches"), F.countDistinct("event_id").alias("events")
    )


@query(
    "a9_event_sink", "clickstream",
    "SELECT CAST(user_id AS VARCHAR) AS key, event_id, event_type FROM clickstream",
)
def _(shop):
    folder = run_folder(shop.spark, "sink")
    sinks.append_table(sources.encode(stream(shop), "user_id"), folder)
    return sinks.appended(shop.spark, folder).select(
        "key", F.get_json_object("value", "$.event_id").cast("long").alias("event_id"), F.get_json_object("value", "$.event_type").alias("event_type")
    )


FEATURES = "count(*) AS events, count(*) FILTER (event_type = 'purchase') AS purchases, CAST(sum(CAST(dwell_time AS DECIMAL(18,2))) AS DOUBLE) AS dwell_time FROM clickstream"


def routed(shop):
    """The events, one file per batch, sent to two appended tables and two tables of running totals."""
    folder = run_folder(shop.spark, "routes")
    totals = {
        f"{name}-features": MergedTable(f"{folder}/{name}-features", lambda df, key=key: partial_totals(df, [key]), merge_totals([key]))
        for name, key in (("user", "user_id"), ("product", "product_id"))
    }
    outputs = {"raw": lambda df: df, "processed": C.enrich, **totals}
    sinks.run_available(in_files(shop), sinks.route(outputs, folder), f"{folder}/checkpoint")
    return folder, {name: finished_totals(table.read(shop.spark)) for name, table in totals.items()}


@query(
    "a10_topic_routing", "clickstream",
    f"""SELECT 'raw' AS topic, count(*) AS rows, {FEATURES} UNION ALL SELECT 'processed', count(*), {FEATURES}
UNION ALL SELECT 'user-features', count(DISTINCT user_id), {FEATURES} UNION ALL SELECT 'product-features', count(DISTINCT product_id), {FEATURES}""",
)
def _(shop):
    """Rows and totals of every topic; those of the feature topics add up their running totals."""
    folder, features = routed(shop)
    one = F.lit(1).cast("long")
    events = {name: shop.spark.read.parquet(f"{folder}/{name}") for name in ("raw", "processed")}
    parts = {name: df.select(one.alias("e"), F.when(F.col("event_type") == "purchase", one).otherwise(0).alias("p"), F.col("dwell_time").alias("d")) for name, df in events.items()}
    parts |= {name: df.select(F.col("total_events").alias("e"), F.col("purchase_count").alias("p"), F.col("total_dwell_time").alias("d")) for name, df in features.items()}
    out = None
    for name, df in parts.items():
        part = df.agg(F.count(F.lit(1)).alias("rows"), F.sum("e").alias("events"), F.sum("p").alias("purchases"), exact_sum("d").alias("dwell_time")).select(F.lit(name).alias("topic"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query("a10_user_features", "clickstream", f"SELECT user_id, {TOTALS} FROM clickstream GROUP BY 1")
def _(shop):
    return stamped(routed(shop)[1]["user-features"], "last_activity")


@query("a10_product_features", "clickstream", f"SELECT product_id, {TOTALS} FROM clickstream GROUP BY 1")
def _(shop):
    return stamped(routed(shop)[1]["product-features"], "last_activity")


@query("p1_stream_enrichment", "clickstream", ENRICHED)
def _(shop):
    folder = run_folder(shop.spark, "enriched")
    sinks.append_table(C.enrich(stream(shop)).select(*ENRICHED_COLUMNS), folder)
    return sinks.appended(shop.spark, folder)


def updated(shop, df, keys):
    folder = run_folder(shop.spark, "updates")
    sinks.update_table(df, folder)
    return sinks.latest_updates(shop.spark, folder, keys)


@query("p2_stream_user_totals", "clickstream", f"SELECT user_id, {TOTALS} FROM clickstream GROUP BY 1")
def _(shop):
    return stamped(updated(shop, C.user_totals(stream(shop)), ["user_id"]), "last_activity")


def running_totals(shop, keys, audience, spread=None):
    """Totals merged from one delta per file."""
    folder = run_folder(shop.spark, "totals")
    table = MergedTable(folder, lambda df: partial_totals(df, keys, audience, spread), merge_totals(keys))
    sinks.run_available(in_files(shop), table, f"{folder}/checkpoint")
    return stamped(finished_totals(table.read(shop.spark), list(spread or {})), "last_activity")


def within_bound(totals, exact, name):
    """The exact count in place of the sketch's estimate, the estimate's error bound, and whether it was kept."""
    kept = F.abs(totals[f"unique_{name}_id"] - exact) <= F.ceil(exact * SKETCH_BOUND)
    return {f"unique_{name}s": exact, f"{name}s_within_bound": kept, "bound": F.lit(round(SKETCH_BOUND, 5))}


@query(
    "p3_stream_product_totals", "clickstream",
    f"""SELECT product_id, {TOTALS}, count(DISTINCT user_id) AS unique_users, true AS users_within_bound, {round(SKETCH_BOUND, 5)}e0 AS bound
FROM clickstream GROUP BY 1""",
)
def _(shop):
    """The audience is a union of sketches over the batches; beside it stands the exact count that it is held against."""
    found = running_totals(shop, ["product_id"], ["user_id"])
    exact = shop.clickstream.groupBy(F.col("product_id").alias("_p")).agg(F.countDistinct("user_id").alias("_n"))
    joined = found.join(exact, found["product_id"].eqNullSafe(exact["_p"]), "left")
    return joined.withColumns(within_bound(joined, F.col("_n"), "user")).drop("_p", "_n", "unique_user_id")


@query(
    "p4_stream_global_totals", "clickstream",
    f"""WITH d AS ({DISTRIBUTIONS}) SELECT {TOTALS}, count(DISTINCT user_id) AS unique_users, count(DISTINCT product_id) AS unique_products,
true AS users_within_bound, true AS products_within_bound, {round(SKETCH_BOUND, 5)}e0 AS bound,
(SELECT counts FROM d WHERE distribution = 'event_type') AS event_type_distribution, (SELECT counts FROM d WHERE distribution = 'device_type') AS device_type_distribution,
(SELECT counts FROM d WHERE distribution = 'hour') AS hour_distribution FROM clickstream""",
)
def _(shop):
    spread = {"event_type": F.col("event_type"), "device_type": F.col("device_type"), "hour": F.format_string("%02d", F.hour("ts"))}
    found = running_totals(shop, [], ["user_id", "product_id"], spread)
    counts = shop.clickstream.agg(F.struct(F.countDistinct("user_id").alias("u"), F.countDistinct("product_id").alias("p")).alias("c")).scalar()
    found = found.withColumn("_c", counts)
    columns = within_bound(found, F.col("_c.u"), "user") | within_bound(found, F.col("_c.p"), "product")
    return found.withColumns(columns).drop("_c", "unique_user_id", "unique_product_id")


@query(
    "p5_stream_sessions", "clickstream",
    f"""WITH {SESSIONS} SELECT user_id, {STAMP.format('session_start')} AS session_start, {STAMP.format('session_end')} AS session_end, events, purchases, dwell_time FROM sessions""",
)
def _(shop):
    """Sessions leave the stream when the watermark has passed them, so one late closing event is sent at the end."""
    folder = run_folder(shop.spark, "sessions")
    events = shop.clickstream
    events.write.parquet(f"{folder}/in/part=1")
    found = S.user_sessions(S.watermarked(sources.parquet_events(shop.spark, f"{folder}/in", events.schema)))
    sinks.append_table(found, folder)
    closing = events.agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts")).withColumn("user_id", F.lit(-1).cast("long"))
    closing.select(*[F.col(f.name) if f.name in ("ts", "user_id") else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema]).write.parquet(
        f"{folder}/in/part=2"
    )
    sinks.append_table(found, folder)
    rows = sinks.appended(shop.spark, folder)
    return stamped(rows, "session_start", "session_end").select("user_id", "session_start", "session_end", "events", "purchases", "dwell_time")


@query(
    "p6_stream_product_windows", "clickstream",
    f"SELECT {STAMP.format('time_bucket(INTERVAL 60 MINUTE, ts)')} AS window_start, product_id, {TOTALS} FROM clickstream GROUP BY 1, 2",
)
def _(shop):
    rows = updated(shop, S.hourly_products(S.watermarked(stream(shop))), ["window_start", "product_id"])
    return stamped(rows, "window_start", "last_activity")


@query(
    "p7_stream_global_windows", "clickstream",
    f"""WITH w AS (SELECT c.*, time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS ws FROM clickstream c, range(4) r(k))
SELECT {STAMP.format('ws')} AS window_start, {TOTALS} FROM w GROUP BY 1""",
)
def _(shop):
    rows = updated(shop, S.sliding_totals(S.watermarked(stream(shop))), ["window_start"])
    return stamped(rows, "window_start", "last_activity")


@query(
    "p10_stream_scores", "clickstream",
    f"""SELECT event_id, {ENGAGEMENT} AS engagement_score, CASE event_type WHEN 'view' THEN 0.1e0 WHEN 'click' THEN 0.3e0 WHEN 'add_to_cart' THEN 0.5e0
WHEN 'purchase' THEN 1e0 ELSE 0e0 END AS popularity_score FROM clickstream""",
)
def _(shop):
    folder = run_folder(shop.spark, "scores")
    sinks.append_table(C.event_scores(stream(shop)).select("event_id", "engagement_score", "popularity_score"), folder)
    return sinks.appended(shop.spark, folder)


@query("p12_stream_upsert", "clickstream", LATEST)
def _(shop):
    """Ten batches; each rewrites the buckets of the users it holds."""
    folder = run_folder(shop.spark, "upsert")
    events = in_files(shop)
    table = BucketTable(f"{folder}/table", "user_id", C.user_rows(shop.clickstream).schema, C.user_rows, lambda old, new: C.upsert_latest(old, new, "user_id"))
    sinks.run_available(events, table, f"{folder}/checkpoint")
    return stamped(table.read(shop.spark), "last_activity")


@query(
    "p13_stream_running_means", "clickstream",
    FOLD.format(key="user_id") + " SELECT k AS user_id, total AS total_views, round(d, 9) AS avg_dwell_time, round(s, 9) AS avg_scroll_depth FROM f WHERE n = total",
)
def _(shop):
    """Two halves of the month, the second going on from the means of the first."""
    folder = run_folder(shop.spark, "means")
    events, half = shop.clickstream, F.lit("2024-01-15").cast("timestamp")
    table = S.means_table(f"{folder}/table")
    for part, rows in enumerate((events.where(F.col("ts") < half), events.where(F.col("ts") >= half))):
        rows.write.parquet(f"{folder}/in/part={part}")
        sinks.run_available(sources.parquet_events(shop.spark, f"{folder}/in", events.schema), table, f"{folder}/checkpoint")
    return table.read(shop.spark).drop("last_activity").withColumns({c: F.round(c, 9) for c in ("avg_dwell_time", "avg_scroll_depth")})


@query("p16_late_data", "clickstream", f"SELECT {STAMP.format('time_bucket(INTERVAL 60 MINUTE, ts)')} AS window_start, count(*) AS n FROM clickstream GROUP BY 1")
def _(shop):
    """A second pass over the first day's events arrives a month late and changes nothing."""
    folder = run_folder(shop.spark, "late")
    rows = shop.clickstream.select("event_id", "ts")
    rows.write.parquet(f"{folder}/in/part=1")
    counts = S.watermarked(sources.parquet_events(shop.spark, f"{folder}/in", rows.schema)).groupBy(F.window("ts", "60 minutes").alias("w")).agg(
        F.count(F.lit(1)).alias("n")
    ).select(F.col("w.start").alias("window_start"), "n")
    sinks.update_table(counts, folder)
    rows.where(F.col("ts") < F.lit("2024-01-02").cast("timestamp")).write.parquet(f"{folder}/in/part=2")
    sinks.update_table(counts, folder)
    return stamped(sinks.latest_updates(shop.spark, folder, ["window_start"]), "window_start")


@query("p17_deduplication", "clickstream", PLAIN)
def _(shop):
    """Every event is sent twice."""
    folder, doubled = run_folder(shop.spark, "dedup"), run_folder(shop.spark, "doubled")
    shop.clickstream.unionByName(shop.clickstream).write.parquet(doubled)
    events = sources.parquet_events(shop.spark, doubled, shop.clickstream.schema)
    sinks.append_table(S.distinct_events(S.watermarked(events, "40 days")), folder)
    return plain(sinks.appended(shop.spark, folder))


@query(
    "p18_stream_static_join", "clickstream users products",
    """SELECT event_id, u.income_level, p.category FROM clickstream LEFT JOIN users u USING (user_id) LEFT JOIN products p USING (product_id)""",
)
def _(shop):
    folder = run_folder(shop.spark, "joined")
    users, products = shop.users.select("user_id", "income_level"), shop.products.select("product_id", "category")
    sinks.append_table(S.with_attributes(stream(shop), users, products).select("event_id", "income_level", "category"), folder)
    return sinks.appended(shop.spark, folder)


@query(
    "p19_stream_report", "clickstream", f"SELECT count(*) AS events_in, {FILES} AS batches, count(*) AS processed, 0 AS errors, 100e0 AS success_pct FROM clickstream"
)
def _(shop):
    """Every batch of the run, as a listener wrote it to a table."""
    folder = run_folder(shop.spark, "report")
    events = sources.decode(sources.file_records(shop.spark, topic(shop), max_files=1), EVENT)
    with sinks.logged(shop.spark, f"{folder}/progress") as log:
        batches = log.of(sinks.append_table(events, folder))
    seen = batches.where("input_rows > 0").agg(F.sum("input_rows").alias("events_in"), F.count(F.lit(1)).cast("int").alias("batches"))
    bad = F.col(sources.CORRUPT).isNotNull()
    wrote = shop.spark.read.parquet(f"{folder}/data").agg(F.struct(F.count_if(~bad).alias("ok"), F.count_if(bad).alias("bad")).alias("r")).scalar()
    return seen.withColumn("_r", wrote).select(
        "events_in", "batches", F.col("_r.ok").alias("processed"), F.col("_r.bad").cast("int").alias("errors"), (F.col("_r.ok") / F.col("events_in") * 100).alias("success_pct")
    )


@query("p20_bad_records", "clickstream", "SELECT event_id % 50 = 7 AS is_bad, count(*) AS rows FROM clickstream GROUP BY 1")
def _(shop):
    """Every fiftieth record is cut short; it goes to the side table and the rest goes on."""
    folder, broken = run_folder(shop.spark, "bad"), run_folder(shop.spark, "broken")
    good = sources.encode(shop.clickstream, "event_id")
    good.withColumn("value", F.when(F.col("key").cast("long") % 50 == 7, F.substring("value", 1, 20)).otherwise(F.col("value"))).write.json(broken)
    is_bad = F.col(sources.CORRUPT).isNotNull()
    outputs = {"good": lambda df: df.where(~is_bad).drop(sources.CORRUPT), "bad": lambda df: df.where(is_bad).select("key", sources.CORRUPT)}
    events = sources.decode(sources.file_records(shop.spark, broken), EVENT)
    sinks.run_available(events, sinks.route(outputs, folder), f"{folder}/checkpoint")
    counts = [
        shop.spark.read.parquet(f"{folder}/{name}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name == "bad").alias("is_bad"), "rows")
        for name in outputs
    ]
    return counts[0].unionByName(counts[1])


@query("t1_message_handler", "clickstream", "SELECT device_type, count(*) AS n FROM clickstream GROUP BY 1")
def _(shop):
    """A user function is called with every batch of events."""
    folder = run_folder(shop.spark, "handler")

    def handler(df, batch):
        sinks.write_batch(df.groupBy("device_type").agg(F.count(F.lit(1)).alias("n")), f"{folder}/data", batch)

    sinks.run_available(stream(shop), handler, f"{folder}/checkpoint")
    return shop.spark.read.parquet(f"{folder}/data").groupBy("device_type").agg(F.sum("n").alias("n"))


@query(
    "t2_alert_callback", "metrics",
    f"""SELECT {STAMP.format('time_bucket(INTERVAL 60 MINUTE, ts)')} AS ts, 'critical' AS severity FROM metrics GROUP BY 1
HAVING count(*) FILTER (metric_name = 'error') / greatest(count(*) FILTER (metric_name = 'latency_ms'), 1) * 100e0 > 5""",
)
def _(shop):
    """Alerts on closed windows go to a callback. A window reaches it once, when the watermark has passed its end, so an alert
    that later samples would lift is never raised. One sample after the end of the month closes the last windows."""
    folder = run_folder(shop.spark, "callback")
    samples = shop.metrics.select("ts", "metric_name")
    samples.write.parquet(f"{folder}/in/part=1")
    stream_of = sources.parquet_events(shop.spark, f"{folder}/in", samples.schema)
    rates = M.error_rates(S.watermarked(stream_of).withColumn("w", F.window("ts", "60 minutes")), ["w"]).withColumn("window_start", F.col("w.start"))

    def callback(df, batch):
        values = df.select("window_start", F.lit("error_rate").alias("metric_name"), F.col("error_rate").alias("value"))
        sinks.write_batch(M.alerts(values).where("severity = 'critical'"), f"{folder}/data", batch)

    sinks.run_available(rates, callback, f"{folder}/checkpoint")
    last = samples.agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"))
    last.withColumn("metric_name", F.lit("latency_ms")).write.parquet(f"{folder}/in/part=2")
    sinks.run_available(rates, callback, f"{folder}/checkpoint")
    return shop.spark.read.parquet(f"{folder}/data").select(stamp("ts").alias("ts"), "severity")


@query(
    "t3_pluggable_features", "users clickstream",
    "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') * 2 AS boosted FROM clickstream GROUP BY 1",
)
def _(shop):
    """A feature function chosen by the caller, applied with DataFrame.transform."""
    engineer = lambda df: df.withColumn("boosted", F.col("purchase_count") * 2)
    return C.user_totals(shop.clickstream).transform(engineer).select("user_id", F.col("total_events").alias("n"), "boosted")
