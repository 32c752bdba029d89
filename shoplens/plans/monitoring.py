"""Monitoring, alert and rollback queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens.functions.scalars import stamp
from shoplens.operators import monitor as M
from shoplens.plans.registry import query
from shoplens.sources import sinks

WS = "strftime(time_bucket(INTERVAL {0} MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start"
LATENCY = "(SELECT * FROM metrics WHERE metric_name = 'latency_ms')"
P95 = "list_sort(list(metric_value))[CAST(floor(0.95e0 * count(*)) AS BIGINT) + 1]"


def latency(shop):
    return shop.metrics.where("metric_name = 'latency_ms'")


@query(
    "s1_window_summary", "metrics",
    f"""SELECT {WS.format(60)}, metric_name, count(*) AS count, CAST(sum(CAST(metric_value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean, min(metric_value) AS min,
max(metric_value) AS max, round(CASE WHEN count(*) > 1 THEN stddev_samp(metric_value) ELSE 0 END, 6) AS std, round(median(metric_value), 6) AS median FROM metrics GROUP BY 1, 2""",
)
def _(shop):
    out = M.summary(M.in_windows(shop.metrics, "60 minutes"), ["window_start", "metric_name"])
    return out.withColumns({"std": F.round("std", 6), "median": F.round("median", 6), "window_start": stamp("window_start")})


@query(
    "s1_recent_summary", "metrics",
    """SELECT metric_name, count(*) AS count, CAST(sum(CAST(metric_value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean, min(metric_value) AS min,
max(metric_value) AS max, round(CASE WHEN count(*) > 1 THEN stddev_samp(metric_value) ELSE 0 END, 6) AS std, round(median(metric_value), 6) AS median FROM metrics
WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 5760 MINUTE AND ts <= TIMESTAMP '2024-01-31' GROUP BY 1""",
)
def _(shop):
    out = M.summary(M.recent(shop.metrics, shop.stream_now, 5760), ["metric_name"])
    return out.withColumns({"std": F.round("std", 6), "median": F.round("median", 6)})


NEAREST = ", ".join(
    f"CASE WHEN count(*) > 10 THEN list_sort(list(metric_value))[CAST(floor({q}e0 * count(*)) AS BIGINT) + 1] END AS {p}" for p, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))
)


@query("s2_latency_percentiles", "metrics", f"SELECT {WS.format(60)}, count(*) AS n_values, {NEAREST} FROM {LATENCY} GROUP BY 1")
def _(shop):
    out = M.nearest_percentiles(M.in_windows(latency(shop), "60 minutes"), "metric_value", ["window_start"])
    return out.withColumn("window_start", stamp("window_start"))


@query(
    "s3_error_rate", "metrics",
    f"""SELECT {WS.format(60)}, count(*) FILTER (metric_name = 'error') AS errors, count(*) FILTER (metric_name = 'latency_ms') AS requests,
count(*) FILTER (metric_name = 'error') / greatest(count(*) FILTER (metric_name = 'latency_ms'), 1) * 100e0 AS error_rate FROM metrics GROUP BY 1""",
)
def _(shop):
    return M.error_rates(M.in_windows(shop.metrics, "60 minutes"), ["window_start"]).withColumn("window_start", stamp("window_start"))


def _alerts(minutes: int) -> str:
    bucket = f"time_bucket(INTERVAL {minutes} MINUTE, ts)"
    return f"""
vals AS (
  SELECT {bucket} AS ws, 'latency_p95' AS metric_name, {P95} AS v FROM {LATENCY} GROUP BY 1 HAVING count(*) > 10
  UNION ALL SELECT {bucket}, 'error_rate', count(*) FILTER (metric_name = 'error') / greatest(count(*) FILTER (metric_name = 'latency_ms'), 1) * 100e0 FROM metrics
    GROUP BY 1 HAVING count(*) FILTER (metric_name = 'error') > 0
  UNION ALL SELECT {bucket}, 'ctr_drop', (0.05e0 - count(*) FILTER (event_type = 'click') / count(*) FILTER (event_type = 'view')) / 0.05e0 * 100e0 FROM clickstream
    GROUP BY 1 HAVING count(*) FILTER (event_type = 'view') > 0),
limits AS (SELECT * FROM (VALUES ('latency_p95', 300e0, 200e0), ('error_rate', 5e0, 2e0), ('ctr_drop', 20e0, 10e0)) t(metric_name, c, w)),
alerts AS (SELECT regexp_replace(metric_name, '_p95$', '') || '_' || severity || '_' || CAST(epoch(ws) AS BIGINT) AS alert_id, ws AS ts, metric_name, v AS current_value,
  CASE severity WHEN 'critical' THEN c ELSE w END AS threshold_value, severity
  FROM (SELECT *, CASE WHEN v > c THEN 'critical' WHEN v > w THEN 'warning' END AS severity FROM vals JOIN limits USING (metric_name)) WHERE severity IS NOT NULL)"""


def found(shop, width):
    return M.alerts(M.window_values(shop.metrics, shop.clickstream, width))


TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"


@query("s4_alerts", "metrics clickstream", f"WITH {_alerts(60)} SELECT alert_id, {TS}, metric_name, current_value, threshold_value, severity FROM alerts")
def _(shop):
    return found(shop, "60 minutes").select("alert_id", stamp("ts").alias("ts"), "metric_name", "current_value", "threshold_value", "severity")


DAY = "ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '2024-01-30 12:00:00'"


@query(
    "s5_baselines", "metrics clickstream",
    f"""SELECT (SELECT CAST(sum(CAST(metric_value AS DECIMAL(18,2))) AS DOUBLE) / count(*) FROM metrics WHERE metric_name = 'latency_ms' AND {DAY}) AS baseline_latency_ms,
(SELECT count(*) FILTER (event_type = 'click') / count(*) FILTER (event_type = 'view') FROM clickstream WHERE {DAY}) AS baseline_ctr,
(SELECT count(*) FILTER (metric_name = 'error') / count(*) FILTER (metric_name = 'latency_ms') * 100e0 FROM metrics WHERE {DAY}) AS baseline_error_rate""",
)
def _(shop):
    return M.baselines(shop.metrics, shop.clickstream, F.lit("2024-01-30 12:00:00").cast("timestamp"))


@query(
    "s6_two_sigma", "clickstream",
    f"""WITH r AS (SELECT {WS.format(60)}, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks,
count(*) FILTER (event_type = 'purchase') AS purchases FROM clickstream GROUP BY 1 HAVING count(*) FILTER (event_type = 'view') > 0),
s AS (SELECT *, clicks / views AS ctr, purchases / views AS conversion FROM r),
m AS (SELECT *, avg(ctr) OVER w AS mc, stddev_pop(ctr) OVER w AS sc, avg(conversion) OVER w AS mv FROM s WINDOW w AS (ORDER BY window_start ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT window_start, views, clicks, purchases, ctr, conversion, round(mc, 6) AS mean_ctr, round(sc, 6) AS std_ctr, round(mv, 6) AS mean_conversion,
coalesce(ctr < mc - 2 * sc, false) AS ctr_breach, coalesce(conversion < mv * 0.85e0, false) AS conversion_breach FROM m""",
)
def _(shop):
    out = M.two_sigma(shop.clickstream)
    return out.withColumns({**{c: F.round(c, 6) for c in ("mean_ctr", "std_ctr", "mean_conversion")}, "window_start": stamp("window_start")})


@query(
    "s7_sustained_breach", "metrics",
    f"""WITH v AS (SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS ws, max(metric_value) AS v FROM {LATENCY} GROUP BY 1),
h AS (SELECT *, CAST(floor(epoch(ws) / 3600) AS BIGINT) - row_number() OVER (ORDER BY ws) AS run FROM v WHERE v > 120)
SELECT strftime(min(ws), '%Y-%m-%d %H:%M:%S') AS breach_start, strftime(max(ws), '%Y-%m-%d %H:%M:%S') AS breach_end, count(*) AS buckets, max(v) AS peak
FROM h GROUP BY run HAVING count(*) > 3""",
)
def _(shop):
    hourly = M.in_windows(latency(shop), "60 minutes").groupBy("window_start").agg(F.max("metric_value").alias("value"))
    out = M.sustained(hourly, 120.0, 3600, 3)
    return out.withColumns({c: stamp(c) for c in ("breach_start", "breach_end")})


@query(
    "s8_performance_report", "metrics clickstream",
    f"""WITH {_alerts(60)}, l AS (SELECT * FROM alerts WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '2024-01-31'),
t AS (SELECT * FROM l ORDER BY ts DESC, alert_id DESC LIMIT 10),
h AS (SELECT avg(metric_value) FILTER (metric_name = 'latency_ms') AS lat, count(*) FILTER (metric_name = 'error') / greatest(count(*) FILTER (metric_name = 'latency_ms'), 1) * 100e0 AS err
  FROM metrics WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 60 MINUTE AND ts <= TIMESTAMP '2024-01-31')
SELECT count(*) AS total_alerts, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning,
(SELECT string_agg(alert_id, ',' ORDER BY ts, alert_id) FROM t) AS recent_alerts,
(SELECT CASE WHEN lat > 200 AND err > 2 THEN '{M.ADVICE["latency"]}; {M.ADVICE["errors"]}' WHEN lat > 200 THEN '{M.ADVICE["latency"]}'
  WHEN err > 2 THEN '{M.ADVICE["errors"]}' ELSE '{M.ADVICE["fine"]}' END FROM h) AS advice FROM l""",
)
def _(shop):
    return M.report(found(shop, "60 minutes"), shop.metrics, shop.stream_now)


ADMISSION = _alerts(5) + """,
crit AS (SELECT alert_id, ts, CAST(epoch(ts) AS BIGINT) AS sec, CASE metric_name WHEN 'latency_p95' THEN 'latency_breach' WHEN 'error_rate' THEN 'error_rate_spike'
  ELSE 'ctr_degradation' END AS trigger, row_number() OVER (ORDER BY ts, alert_id) AS n FROM alerts WHERE severity = 'critical'),
fold AS (
  SELECT 0::BIGINT AS n, -1000000::BIGINT AS a1, -1000000::BIGINT AS a2, -1000000::BIGINT AS a3, '' AS decision
  UNION ALL
  SELECT c.n, CASE WHEN d = 'admitted' THEN c.sec ELSE a1 END, CASE WHEN d = 'admitted' THEN a1 ELSE a2 END, CASE WHEN d = 'admitted' THEN a2 ELSE a3 END, d
  FROM (SELECT c.n, c.sec, f.a1, f.a2, f.a3, CASE WHEN c.sec - f.a1 < 600 THEN 'cooldown' WHEN f.a3 >= c.sec - 3600 THEN 'hourly_limit' ELSE 'admitted' END AS d
        FROM fold f JOIN crit c ON c.n = f.n + 1) c),
decisions AS (SELECT alert_id, ts, sec, 'all' AS scope, trigger, decision FROM crit JOIN fold USING (n))"""


def decisions(shop):
    return M.admit(found(shop, "5 minutes"))


@query("s9_rollback_admission", "metrics clickstream", f"WITH RECURSIVE {ADMISSION} SELECT alert_id, {TS}, scope, trigger, decision FROM decisions")
def _(shop):
    return decisions(shop).withColumn("ts", stamp("ts"))


@query(
    "s11_rollback_statistics", "metrics clickstream",
    f"""WITH RECURSIVE {ADMISSION}, e AS (SELECT *, CAST(epoch(TIMESTAMP '2024-01-31') AS BIGINT) - sec AS age, decision = 'admitted' AS done FROM decisions),
t AS (SELECT trigger, count(*) AS n FROM e WHERE done GROUP BY 1)
SELECT count(*) AS requests, count(*) FILTER (done) AS rollbacks, count(*) FILTER (done) / greatest(count(*), 1) * 100e0 AS admitted_pct,
count(*) FILTER (done AND age <= 86400) AS rollbacks_last_24h, count(*) FILTER (done AND age <= 3600) AS rollbacks_last_hour, max(sec) FILTER (done) AS last_rollback,
(SELECT string_agg(trigger || ':' || n, ',' ORDER BY trigger) FROM t) AS by_trigger FROM e""",
)
def _(shop):
    return M.rollback_statistics(decisions(shop), shop.stream_now)


@query(
    "s12_recorded_metrics", "metrics",
    """SELECT metric_name, model_version, count(*) AS samples, count(DISTINCT user_id) AS users, CAST(sum(CAST(metric_value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean
FROM metrics GROUP BY 1, 2""",
)
def _(shop):
    folder = sinks.run_folder(shop.spark, "metrics")
    M.record(shop.metrics, folder)
    stored = shop.spark.read.schema("event_id long, ts timestamp, metric_value double, user_id long, model_version string, metric_name string").parquet(folder)
    return M.by_version(stored)
