"""Service metrics over time windows, alerts, and the admission of rollbacks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoplens.functions.ordered import exact_quantiles, framed, running
from shoplens.functions.scalars import count_text, exact_mean, lookup
from shoplens.operators.ordering import first_rows, nearest_percentiles
from shoplens.schemas import ALERT_RULES, COOLDOWN_SECONDS, ROLLBACKS_PER_HOUR

ACTIONS = {
    ("latency_p95", "critical"): "Roll back unless the slow requests have another known cause",
    ("latency_p95", "warning"): "Look at the slowest requests and keep the window under watch",
    ("error_rate", "critical"): "Roll back now: too many requests fail",
    ("error_rate", "warning"): "Find out which requests fail",
    ("ctr_drop", "critical"): "Roll back: users have stopped clicking what they are shown",
    ("ctr_drop", "warning"): "Compare the lists shown with those of the baseline period",
}
# fixed values
TRIGGERS = {"latency_p95": "latency_breach", "error_rate": "error_rate_spike", "ctr_drop": "ctr_degradation"}
BASELINE_CTR = 0.05
ADVICE = {
    "latency": "requests take too long: profile the serving path",
    "errors": "too many requests fail: read the error log",
    "fine": "nothing to do",
}
TWO_SIGMA, CONVERSION_DROP = 2.0, 0.15


def recent(metrics: DataFrame, as_of: Column, minutes: int) -> DataFrame:
    return metrics.where((F.col("ts") >= as_of - F.expr(f"INTERVAL {int(minutes)} MINUTES")) & (F.col("ts") <= as_of))


def in_windows(metrics: DataFrame, width: str) -> DataFrame:
    return metrics.withColumn("window_start", F.window("ts", width)["start"])


def summary(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Count, mean, exact median, extremes and sample deviation (0 for a single value)."""
    value = F.col("metric_value")
    basic = metrics.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), exact_mean("metric_value").alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.when(F.count(value) > 1, F.stddev_samp(value)).otherwise(F.lit(0.0)).alias("std"),
    )
    medians = exact_quantiles(metrics, "metric_value", {"median": 0.5}, by=by).drop("n_values")
    there = medians.withColumnsRenamed({k: f"_m_{k}" for k in by})
    same = F.lit(True)
    for k in by:
        same = same & basic[k].eqNullSafe(there[f"_m_{k}"])
    return basic.join(there, same).drop(*[f"_m_{k}" for k in by])


def error_rates(metrics: DataFrame, by: list[str]) -> DataFrame:
    return metrics.groupBy(*by).agg(
        F.count_if(F.col("metric_name") == "error").alias("errors"), F.count_if(F.col("metric_name") == "latency_ms").alias("requests")
    ).withColumn("error_rate", F.col("errors") / F.greatest(F.col("requests"), F.lit(1)) * F.lit(100.0))


def click_rates(events: DataFrame, by: list[str]) -> DataFrame:
    """Clicks per view where there are views."""
    return events.groupBy(*by).agg(
        F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "click").alias("clicks"),
        F.count_if(F.col("event_type") == "purchase").alias("purchases"),
    ).where(F.col("views") > 0).withColumn("ctr", F.col("clicks") / F.col("views"))


def window_values(metrics: DataFrame, events: DataFrame, width: str, baseline_ctr: Column | float = BASELINE_CTR) -> DataFrame:
    """(window_start, metric_name, value) of the three watched metrics."""
    windows, by = in_windows(metrics, width), ["window_start"]
    latency = nearest_percentiles(windows.where("metric_name = 'latency_ms'"), "metric_value", by).select(
        *by, F.lit("latency_p95").alias("metric_name"), F.col("p95").alias("value")
    )
    errors = error_rates(windows, by).where("errors > 0").select(*by, F.lit("error_rate").alias("metric_name"), F.col("error_rate").alias("value"))
    base = baseline_ctr if isinstance(baseline_ctr, Column) else F.lit(baseline_ctr)
    drops = click_rates(in_windows(events, width), by).withColumn("_b", base).select(
        *by, F.lit("ctr_drop").alias("metric_name"), ((F.col("_b") - F.col("ctr")) / F.col("_b") * F.lit(100.0)).alias("value")
    )
    return latency.unionByName(errors).unionByName(drops)


def alerts(values: DataFrame) -> DataFrame:
    """One alert per breached metric and window; a critical breach replaces the warning."""
    limits = {s: {m: t for m, sev, t in ALERT_RULES if sev == s} for s in ("critical", "warning")}
    metric, value = F.col("metric_name"), F.col("value")
    critical, warning = lookup(metric, limits["critical"]), lookup(metric, limits["warning"])
    severity = F.when(value > critical, "critical").when(value > warning, "warning")
    found = values.withColumn("severity", severity).where(F.col("severity").isNotNull()).withColumn(
        "threshold_value", F.when(F.col("severity") == "critical", critical).otherwise(warning)
    )
    action = lookup(F.concat_ws("/", metric, "severity"), {"/".join(k): v for k, v in ACTIONS.items()})
    label = F.regexp_replace(F.col("metric_name"), "_p95$", "")
    unit = F.when(metric == "latency_p95", "ms").otherwise("%")
    message = F.concat(
        metric, F.lit(" "), F.format_string("%.1f", value), unit, F.lit(" exceeds the "), "severity", F.lit(" threshold of "),
        F.format_string("%.1f", F.col("threshold_value")), unit,
    )
    return found.select(
        F.concat_ws("_", label, "severity", F.unix_timestamp("window_start").cast("string")).alias("alert_id"),
        F.col("window_start").alias("ts"), "metric_name", F.col("value").alias("current_value"), "threshold_value", "severity",
        message.alias("message"), action.alias("suggested_action"),
    )


def baselines(metrics: DataFrame, events: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Mean latency, click rate and error rate of the last hours, one row."""
    samples = recent(metrics, as_of, hours * 60)
    latency = samples.where("metric_name = 'latency_ms'").agg(exact_mean("metric_value").alias("m")).scalar()
    rates = click_rates(recent(events, as_of, hours * 60), []).agg(F.max("ctr").alias("c")).scalar()
    return error_rates(samples, []).select(
        latency.alias("baseline_latency_ms"), rates.alias("baseline_ctr"), F.col("error_rate").alias("baseline_error_rate")
    )


def two_sigma(events: DataFrame, width: str = "1 hour", buckets: int = 24) -> DataFrame:
    """Click rate below mean - 2 deviations of the preceding buckets, or conversion down 15 % on them.

    Rows are one per time bucket; the frames over the preceding ones are computed piece by piece.
    """
    rates = click_rates(in_windows(events, width), ["window_start"]).withColumn("conversion", F.col("purchases") / F.col("views"))
    means = {
        "mean_ctr": lambda w: F.avg("ctr").over(w), "std_ctr": lambda w: F.stddev_pop("ctr").over(w), "mean_conversion": lambda w: F.avg("conversion").over(w),
    }
    return framed(rates, ["window_start"], buckets, means).withColumns(
        {
            "ctr_breach": F.coalesce(F.col("ctr") < F.col("mean_ctr") - F.lit(TWO_SIGMA) * F.col("std_ctr"), F.lit(False)),
            "conversion_breach": F.coalesce(F.col("conversion") < F.col("mean_conversion") * F.lit(1 - CONVERSION_DROP), F.lit(False)),
        }
    )


def sustained(values: DataFrame, threshold: float, bucket_seconds: int, min_buckets: int) -> DataFrame:
    """Runs of consecutive buckets above the threshold that last longer than ``min_buckets`` buckets.

    ``values`` has one row per bucket (window_start, value). A bucket's number less its place among the high ones is the same
    within a run; places are running counts over ranges of time.
    """
    high = values.where(F.col("value") > threshold)
    number = F.floor(F.unix_timestamp("window_start") / F.lit(bucket_seconds))
    placed = running(high, ["window_start"], {"_place": F.lit(1)})
    runs = placed.withColumn("_run", number - F.col("_place")).groupBy("_run").agg(
        F.min("window_start").alias("breach_start"), F.max("window_start").alias("breach_end"), F.count(F.lit(1)).alias("buckets"),
        F.max("value").alias("peak"),
    )
    return runs.where(F.col("buckets") > min_buckets).drop("_run")


def report(found: DataFrame, metrics: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Alert counts by severity, the last ten alerts and advice, one row."""
    latest = found.where((F.col("ts") >= as_of - F.expr(f"INTERVAL {int(hours)} HOURS")) & (F.col("ts") <= as_of))
    ten = latest.orderBy(F.col("ts").desc(), F.col("alert_id").desc()).limit(10).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "alert_id"))), lambda a: a["alert_id"]), ",").alias("l")
    ).scalar()
    hour = recent(metrics, as_of, 60)
    slow = hour.where("metric_name = 'latency_ms'").agg(F.avg("metric_value").alias("m")).scalar()
    rate = error_rates(hour, []).select("error_rate").scalar()
    advice = F.array_compact(
        F.array(F.when(F.col("_slow") > 200.0, ADVICE["latency"]), F.when(F.col("_rate") > 2.0, ADVICE["errors"]))
    )
    counts = latest.agg(
        F.count(F.lit(1)).alias("total_alerts"), F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "warning").alias("warning"),
    )
    return counts.withColumns({"recent_alerts": ten, "_slow": slow, "_rate": rate}).withColumn("_a", advice).select(
        "total_alerts", "critical", "warning", "recent_alerts",
        F.when(F.size("_a") == 0, F.lit(ADVICE["fine"])).otherwise(F.array_join("_a", "; ")).alias("advice"),
    )


def admit(found: DataFrame, scope: str | None = None) -> DataFrame:
    """Which critical alerts start a rollback: none within ten minutes of the last, at most three in an hour.

    Alerts of one instant are reduced to the first, and history is cut where more than an hour passes without an
    alert, because nothing before such a pause can block anything after it. Each piece is decided on its own from
    one row per instant. Alerts come one per window and metric, so a piece grows with time, not with traffic.
    """
    key = F.col(scope) if scope else F.lit("all")
    critical = found.where(F.col("severity") == "critical").select("alert_id", "ts", "metric_name", key.alias("scope"), F.unix_timestamp("ts").alias("at"))
    instants = critical.groupBy("scope", "at").agg(F.min("alert_id").alias("first_id"))
    w = W.partitionBy("scope").orderBy("at")
    pause = F.col("at") - F.lag("at").over(w)
    pieces = instants.withColumn("_new", F.when(pause.isNull() | (pause > 3600), 1).otherwise(0)).withColumn(
        "piece", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))
    )

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        admitted: list[int] = []
        verdicts = []
        for at in pdf["at"]:
            if admitted and at - admitted[-1] < COOLDOWN_SECONDS:
                verdicts.append("cooldown")
            elif sum(1 for a in admitted[-ROLLBACKS_PER_HOUR:] if a >= at - 3600) >= ROLLBACKS_PER_HOUR:
                verdicts.append("hourly_limit")
            else:
                admitted.append(at)
                verdicts.append("admitted")
        return pd.DataFrame({"scope": pdf["scope"], "at": pdf["at"], "first_id": pdf["first_id"], "verdict": verdicts})

    decided = pieces.groupBy("scope", "piece").applyInPandas(decide, "scope string, at long, first_id string, verdict string")
    own = F.col("alert_id") == F.col("first_id")
    decision = F.when(~own & (F.col("verdict") == "admitted"), "cooldown").otherwise(F.col("verdict"))
    return critical.join(decided, ["scope", "at"]).select(
        "alert_id", "ts", "scope", lookup(F.col("metric_name"), TRIGGERS).alias("trigger"), decision.alias("decision")
    )


def rollback_statistics(decisions: DataFrame, as_of: Column) -> DataFrame:
    """Totals over admitted rollbacks and blocked requests, one row."""
    done = F.col("decision") == "admitted"
    age = F.unix_timestamp(as_of) - F.unix_timestamp("ts")
    triggers = decisions.where(done).groupBy(F.col("trigger").alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(
        count_text(F.collect_list(F.struct("k", "n"))).alias("t")
    ).scalar()
    return decisions.agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(done).alias("rollbacks"),
        (F.count_if(done) / F.greatest(F.count(F.lit(1)), F.lit(1)) * F.lit(100.0)).alias("admitted_pct"),
        F.count_if(done & (age <= 86400)).alias("rollbacks_last_24h"), F.count_if(done & (age <= 3600)).alias("rollbacks_last_hour"),
        F.max(F.when(done, F.unix_timestamp("ts"))).alias("last_rollback"),
    ).withColumn("by_trigger", triggers)


def record(metrics: DataFrame, folder: str) -> None:
    """Append samples, one directory per metric, so that a summary of one metric reads nothing else."""
    metrics.write.mode("append").partitionBy("metric_name").parquet(folder)


def by_version(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("metric_name", "model_version").agg(
        F.count(F.lit(1)).alias("samples"), F.countDistinct("user_id").alias("users"), exact_mean("metric_value").alias("mean")
    )
