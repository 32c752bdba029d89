"""Clickstream feature queries, batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens.functions.scalars import stamp
from shoplens.operators import clickstream as C
from shoplens.plans.aggregates import DISTRIBUTIONS
from shoplens.plans.registry import query

STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
TOTALS = """count(*) AS total_events, count(*) FILTER (event_type = 'view') AS view_count, count(*) FILTER (event_type = 'click') AS click_count,
count(*) FILTER (event_type = 'add_to_cart') AS add_to_cart_count, count(*) FILTER (event_type = 'purchase') AS purchase_count,
CAST(sum(CAST(dwell_time AS DECIMAL(18,2))) AS DOUBLE) AS total_dwell_time, CAST(sum(CAST(scroll_depth AS DECIMAL(18,2))) AS DOUBLE) AS total_scroll_depth,
strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_activity"""
SESSIONS = """
marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM clickstream),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM marked),
sessions AS (SELECT user_id, CAST(session_no AS BIGINT) AS session_no, min(ts) AS session_start, max(ts) AS session_end, count(*) AS events,
  count(*) FILTER (event_type = 'purchase') AS purchases, CAST(sum(CAST(dwell_time AS DECIMAL(18,2))) AS DOUBLE) AS dwell_time FROM numbered GROUP BY 1, 2)"""
MINUTES = "(epoch_us(session_end) - epoch_us(session_start)) / 60000000e0"
ENGAGEMENT = """least(CASE WHEN coalesce(dwell_time, 0) > 0 THEN least(dwell_time / 300e0, 1e0) * 0.4e0 ELSE 0e0 END
+ CASE WHEN coalesce(scroll_depth, 0) > 0 THEN scroll_depth / 100e0 * 0.3e0 ELSE 0e0 END + CASE WHEN event_type = 'purchase' THEN 0.3e0 ELSE 0e0 END, 1e0)"""
ENRICHED = """SELECT event_id, CAST(event_type = 'view' AS INT) AS event_type_view, CAST(event_type = 'purchase' AS INT) AS event_type_purchase,
CAST(hour(ts) AS INT) AS hour_of_day, CAST(isodow(ts) - 1 AS INT) AS day_of_week, CAST(isodow(ts) >= 6 AS INT) AS is_weekend,
CAST(hour(ts) BETWEEN 9 AND 17 AS INT) AS is_business_hours, nullif(dwell_time, 0) AS dwell_time_seconds,
CASE WHEN nullif(dwell_time, 0) < 10 THEN 'very_short' WHEN nullif(dwell_time, 0) < 30 THEN 'short' WHEN nullif(dwell_time, 0) < 120 THEN 'medium'
 WHEN nullif(dwell_time, 0) < 300 THEN 'long' WHEN nullif(dwell_time, 0) IS NOT NULL THEN 'very_long' END AS dwell_time_category,
nullif(scroll_depth, 0) AS scroll_depth_percentage,
CASE WHEN nullif(scroll_depth, 0) < 25 THEN 'low' WHEN nullif(scroll_depth, 0) < 50 THEN 'medium' WHEN nullif(scroll_depth, 0) < 75 THEN 'high'
 WHEN nullif(scroll_depth, 0) IS NOT NULL THEN 'very_high' END AS scroll_depth_category, CAST(device_type = 'mobile' AS INT) AS device_mobile FROM clickstream"""
ENRICHED_COLUMNS = [
    "event_id", "event_type_view", "event_type_purchase", "hour_of_day", "day_of_week", "is_weekend", "is_business_hours",
    "dwell_time_seconds", "dwell_time_category", "scroll_depth_percentage", "scroll_depth_category", "device_mobile",
]


def stamped(df, *columns):
    return df.withColumns({c: stamp(c) for c in columns})


@query("p1_enrichment", "clickstream", ENRICHED)
def _(shop):
    return C.enrich(shop.clickstream).select(*ENRICHED_COLUMNS)


@query("p2_user_totals", "clickstream", f"SELECT user_id, {TOTALS} FROM clickstream GROUP BY 1")
def _(shop):
    return stamped(C.user_totals(shop.clickstream), "last_activity")


@query("p3_product_totals", "clickstream", f"SELECT product_id, {TOTALS}, count(DISTINCT user_id) AS unique_users FROM clickstream GROUP BY 1")
def _(shop):
    return stamped(C.product_totals(shop.clickstream), "last_activity")


@query(
    "p4_global_totals", "clickstream",
    f"""WITH d AS ({DISTRIBUTIONS}) SELECT count(*) AS total_events, count(DISTINCT user_id) AS unique_users, count(DISTINCT product_id) AS unique_products,
strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_activity, (SELECT counts FROM d WHERE distribution = 'event_type') AS event_type_distribution,
(SELECT counts FROM d WHERE distribution = 'device_type') AS device_type_distribution, (SELECT counts FROM d WHERE distribution = 'hour') AS hour_distribution
FROM clickstream""",
)
def _(shop):
    return stamped(C.global_totals(shop.clickstream), "last_activity")


@query(
    "p5_sessions", "clickstream",
    f"WITH {SESSIONS} SELECT * REPLACE ({STAMP.format('session_start')} AS session_start, {STAMP.format('session_end')} AS session_end) FROM sessions",
)
def _(shop):
    return stamped(C.sessions(shop.clickstream), "session_start", "session_end")


@query(
    "p6_product_windows", "clickstream",
    f"SELECT {STAMP.format('time_bucket(INTERVAL 60 MINUTE, ts)')} AS window_start, product_id, {TOTALS} FROM clickstream GROUP BY 1, 2",
)
def _(shop):
    return stamped(C.product_windows(shop.clickstream), "window_start", "last_activity")


@query(
    "p7_global_windows", "clickstream",
    f"""WITH w AS (SELECT c.*, time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS ws FROM clickstream c, range(4) r(k))
SELECT {STAMP.format('ws')} AS window_start, {TOTALS} FROM w GROUP BY 1""",
)
def _(shop):
    return stamped(C.global_windows(shop.clickstream), "window_start", "last_activity")


@query("p8_session_counts", "clickstream", f"WITH {SESSIONS} SELECT user_id, count(*) AS session_count FROM sessions GROUP BY 1")
def _(shop):
    return C.session_counts(C.sessions(shop.clickstream))


@query(
    "p9_session_durations", "clickstream users",
    f"""WITH {SESSIONS}, r AS (SELECT user_id, {MINUTES} AS m FROM sessions WHERE session_start > TIMESTAMP '2024-01-31' - INTERVAL 30 DAY),
o AS (SELECT user_id, avg(m) AS m FROM r GROUP BY 1)
SELECT user_id, round(coalesce(m, (SELECT avg(m) FROM r)), 6) AS avg_session_duration FROM users LEFT JOIN o USING (user_id)""",
)
def _(shop):
    out = C.session_durations(C.sessions(shop.clickstream), shop.users, shop.stream_now)
    return out.withColumn("avg_session_duration", F.round("avg_session_duration", 6))


@query("p10_event_engagement", "clickstream", f"SELECT event_id, {ENGAGEMENT} AS engagement_score FROM clickstream")
def _(shop):
    return C.event_scores(shop.clickstream).select("event_id", "engagement_score")


@query(
    "p11_event_popularity", "clickstream",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 0.1e0 WHEN 'click' THEN 0.3e0 WHEN 'add_to_cart' THEN 0.5e0 WHEN 'purchase' THEN 1e0 ELSE 0e0 END
AS popularity_score FROM clickstream""",
)
def _(shop):
    return C.event_scores(shop.clickstream).select("event_id", "popularity_score")


LATEST = f"""SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS last_activity, event_id, event_type AS last_event_type, device_type AS last_device,
{ENGAGEMENT} AS engagement_score FROM clickstream QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""


@query("p12_latest_upsert", "clickstream", LATEST)
def _(shop):
    rows = C.user_rows(shop.clickstream)
    half = F.lit("2024-01-15").cast("timestamp")
    before, after = rows.where(F.col("last_activity") < half), rows.where(F.col("last_activity") >= half)
    stored = C.upsert_latest(before.limit(0), before, "user_id")
    return stamped(C.upsert_latest(stored, after, "user_id"), "last_activity")


FOLD = """WITH RECURSIVE v AS (SELECT {key} AS k, nullif(dwell_time, 0) AS d, nullif(scroll_depth, 0) AS s,
  row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY {key}) AS total FROM clickstream WHERE event_type = 'view'),
f AS (SELECT k, n, total, coalesce(d, 0) AS d, coalesce(s, 0) AS s FROM v WHERE n = 1
  UNION ALL SELECT v.k, v.n, v.total, CASE WHEN v.d IS NULL THEN f.d ELSE (f.d * (v.n - 1) + v.d) / v.n END,
    CASE WHEN v.s IS NULL THEN f.s ELSE (f.s * (v.n - 1) + v.s) / v.n END FROM f JOIN v ON v.k = f.k AND v.n = f.n + 1)"""


@query(
    "p13_running_means", "clickstream",
    FOLD.format(key="user_id") + " SELECT k AS user_id, total AS total_views, round(d, 9) AS avg_dwell_time, round(s, 9) AS avg_scroll_depth FROM f WHERE n = total",
)
def _(shop):
    out = C.running_means(shop.clickstream)
    return out.withColumns({c: F.round(c, 9) for c in ("avg_dwell_time", "avg_scroll_depth")})


@query(
    "p14_device_preferences", "clickstream",
    """SELECT user_id, count(*) FILTER (device_type = 'mobile') AS device_preference_mobile, count(*) FILTER (device_type = 'desktop') AS device_preference_desktop,
count(*) FILTER (device_type = 'tablet') AS device_preference_tablet FROM clickstream GROUP BY 1""",
)
def _(shop):
    return C.device_preferences(shop.clickstream)


@query("p14_location_preferences", "clickstream", "SELECT user_id, location, count(*) AS n FROM clickstream GROUP BY 1, 2")
def _(shop):
    return C.location_preferences(shop.clickstream)


@query(
    "p15_state_expiry", "clickstream",
    "SELECT user_id, max(event_id) AS n FROM clickstream GROUP BY 1 HAVING max(ts) > TIMESTAMP '2024-02-28' - INTERVAL 30 DAY",
)
def _(shop):
    state = shop.clickstream.groupBy("user_id").agg(F.max("event_id").alias("n"), F.max("ts").alias("last_activity"))
    return C.live_state(state, F.lit("2024-02-28").cast("timestamp"), 30).select("user_id", "n")
