"""Feature statistics, quality and drift queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens.operators import clickstream as C
from shoplens.operators import profiling as P
from shoplens.operators.featuretable import recent_categories
from shoplens.functions.scalars import weekday_flags
from shoplens.plans.clickstream import MINUTES, SESSIONS
from shoplens.plans.registry import query

NUMBERS = ["price", "rating", "review_count"]


def _profile(feature: str, column: str, source: str) -> str:
    return f"""SELECT '{feature}' AS feature, count(*) AS rows, count({column}) AS n, count(*) - count({column}) AS null_count,
round(avg({column}), 6) AS mean, round(stddev_samp({column}), 6) AS std, CAST(min({column}) AS DOUBLE) AS min, CAST(max({column}) AS DOUBLE) AS max,
(count(*) - count({column})) / count(*) * 100e0 AS null_pct, round(skewness({column}), 6) AS skewness, round(kurtosis({column}), 6) AS kurtosis,
round(quantile_cont(CAST({column} AS DOUBLE), 0.25), 6) AS q25, round(median(CAST({column} AS DOUBLE)), 6) AS median, round(quantile_cont(CAST({column} AS DOUBLE), 0.75), 6) AS q75
FROM {source}"""


@query("r1_numeric_profile", "clickstream", " UNION ALL ".join(_profile(c, c, "clickstream") for c in ("dwell_time", "scroll_depth")))
def _(shop):
    out = P.numeric_profile(shop.clickstream, ["dwell_time", "scroll_depth"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "skewness", "kurtosis", "q25", "median", "q75")})


def _categories(feature: str) -> str:
    return f"""SELECT '{feature}' AS feature, {feature} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {feature}) AS rank,
count(*) OVER () AS distinct_values, CAST(sum(count(*)) OVER () AS BIGINT) AS total, first_value({feature}) OVER (ORDER BY count(*) DESC, {feature}) AS mode,
max(count(*)) OVER () AS mode_count FROM products GROUP BY {feature} QUALIFY rank <= 10"""


@query("r2_categorical_profile", "products", f"SELECT * FROM ({_categories('brand')}) UNION ALL SELECT * FROM ({_categories('category')})")
def _(shop):
    return P.categorical_profile(shop.products, ["brand", "category"])


def features(shop):
    """The catalogue's features as long rows from five relations."""
    found = C.sessions(shop.clickstream).withColumn("minutes", C.duration_minutes())
    flags = weekday_flags(F.col("ts"))
    clock = shop.clickstream.select(*[flags[c].alias(c) for c in ("hour_of_day", "day_of_week", "is_weekend")])
    counts = shop.interactions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    parts = [
        P.long_features(shop.raw_users, {"user_age": "age", "user_income_level": "income_level", "user_preference_category": "preference_category"}),
        P.long_features(
            shop.raw_products.withColumn("price", F.expr("try_cast(price AS DOUBLE)")),
            {"item_price": "price", "item_rating": "rating", "item_category": "category"},
        ),
        P.long_features(clock, {c: c for c in clock.columns}),
        P.long_features(found, {"session_duration_minutes": "minutes"}),
        P.long_features(shop.users.select("user_id").join(counts, "user_id", "left"), {"user_total_interactions": "n"}),
        P.long_features(
            recent_categories(shop.interactions, shop.products, shop.now, 400).select(F.str_to_map("recent_category_counts").alias("m")),
            {"user_recent_category_counts": "m"},
        ),
        P.long_features(found.groupBy("user_id").agg(F.avg("minutes").alias("m")), {"user_avg_session_duration": "m"}),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


CHECKS = f"""{SESSIONS},
s AS (SELECT user_id, {MINUTES} AS m FROM sessions),
long AS (
  SELECT 'user_age' AS feature, CAST(age AS DOUBLE) AS x, CAST(age AS VARCHAR) AS t, 13e0 AS low, 100e0 AS high, NULL AS ok FROM raw_users
  UNION ALL SELECT 'user_income_level', NULL, income_level, NULL, NULL, income_level IN ('low', 'medium', 'high') FROM raw_users
  UNION ALL SELECT 'user_preference_category', NULL, preference_category, NULL, NULL, false FROM raw_users
  UNION ALL SELECT 'item_price', TRY_CAST(price AS DOUBLE), CAST(TRY_CAST(price AS DOUBLE) AS VARCHAR), 0.01e0, 10000e0, NULL FROM raw_products
  UNION ALL SELECT 'item_rating', rating, CAST(rating AS VARCHAR), 1e0, 5e0, NULL FROM raw_products
  UNION ALL SELECT 'item_category', NULL, category, NULL, NULL, false FROM raw_products
  UNION ALL SELECT 'hour_of_day', hour(ts), CAST(hour(ts) AS VARCHAR), 0, 23, NULL FROM clickstream
  UNION ALL SELECT 'day_of_week', isodow(ts) - 1, CAST(isodow(ts) AS VARCHAR), 0, 6, NULL FROM clickstream
  UNION ALL SELECT 'is_weekend', NULL, CAST(isodow(ts) >= 6 AS VARCHAR), NULL, NULL, true FROM clickstream
  UNION ALL SELECT 'session_duration_minutes', m, CAST(m AS VARCHAR), 0, 1440, NULL FROM s
  UNION ALL SELECT 'user_total_interactions', n, CAST(n AS VARCHAR), 0, 100000, NULL FROM users LEFT JOIN (SELECT user_id, count(*) AS n FROM interactions GROUP BY 1) USING (user_id)
  UNION ALL SELECT DISTINCT 'user_recent_category_counts', NULL, CAST(user_id AS VARCHAR), NULL, NULL, NULL FROM interactions WHERE ts > TIMESTAMP '2001-12-01' - INTERVAL 400 DAY
  UNION ALL SELECT 'user_avg_session_duration', avg(m), CAST(avg(m) AS VARCHAR), 0, 1440, NULL FROM s GROUP BY user_id),
counted AS (SELECT feature, count(*) AS rows, count(*) FILTER (t IS NULL) AS null_count, count(*) FILTER (x < low OR x > high) AS out_of_range,
  count(DISTINCT t) FILTER (NOT ok) AS invalid_values, 'passed' AS type_status FROM long GROUP BY 1),
checked AS (SELECT *, out_of_range / rows * 100e0 AS out_of_range_pct, null_count / rows * 100e0 AS null_pct,
  CASE WHEN out_of_range = 0 THEN 'passed' ELSE 'warning' END AS range_status, CASE WHEN invalid_values = 0 THEN 'passed' ELSE 'warning' END AS values_status,
  CASE WHEN null_count / rows * 100e0 < 10 THEN 'passed' WHEN null_count / rows * 100e0 < 50 THEN 'warning' ELSE 'failed' END AS null_status FROM counted)
SELECT *, CASE WHEN null_status = 'failed' THEN 'failed' WHEN 'warning' IN (range_status, values_status, null_status) THEN 'warning' ELSE 'passed' END AS overall_status
FROM checked"""


@query("r3_quality_checks", "users raw_users products raw_products clickstream interactions", "WITH " + CHECKS.lstrip())
def _(shop):
    return P.quality_checks(features(shop), P.catalogue(shop.spark))


@query(
    "r4_catalogue_coverage", "users raw_users products raw_products clickstream interactions",
    "WITH " + CHECKS.lstrip().rsplit("\nSELECT *, CASE", 1)[0] + """
SELECT CASE WHEN feature LIKE 'item%' THEN 'item' WHEN feature IN ('user_age', 'user_income_level', 'user_preference_category') THEN 'user'
WHEN feature LIKE 'user%' THEN 'interaction' ELSE 'contextual' END AS grp, count(*) AS features, CAST(sum(rows) AS BIGINT) AS rows,
CAST(sum(null_count) AS BIGINT) AS null_count, count(*) FILTER (range_status = 'warning') AS range_warnings,
count(*) FILTER (values_status = 'warning') AS value_warnings FROM checked GROUP BY 1""",
)
def _(shop):
    rules = P.catalogue(shop.spark)
    checked = P.quality_checks(features(shop), rules).join(rules.select("feature", "grp"), "feature")
    return checked.groupBy("grp").agg(
        F.count(F.lit(1)).alias("features"), F.sum("rows").alias("rows"), F.sum("null_count").alias("null_count"),
        F.count_if(F.col("range_status") == "warning").alias("range_warnings"), F.count_if(F.col("values_status") == "warning").alias("value_warnings"),
    )


HALF = "2024-01-16"


def halves(shop):
    border = F.lit(HALF).cast("timestamp")
    return shop.clickstream.where(F.col("ts") < border), shop.clickstream.where(F.col("ts") >= border)


def _psi(feature: str) -> str:
    cuts = ", ".join(f"{i / 10}" for i in range(1, 10))
    return f"""(WITH q AS (SELECT quantile_cont({feature}, [{cuts}]) AS cuts FROM clickstream WHERE ts < DATE '{HALF}'),
b AS (SELECT len(list_filter(cuts, lambda x: x < {feature})) AS bin, ts >= DATE '{HALF}' AS later FROM clickstream, q WHERE {feature} IS NOT NULL),
c AS (SELECT bin, count(*) FILTER (NOT later) AS e, count(*) FILTER (later) AS a FROM b GROUP BY 1),
s AS (SELECT greatest(e / (SELECT sum(e) FROM c), 1e-4) AS e, greatest(a / (SELECT sum(a) FROM c), 1e-4) AS a FROM c)
SELECT '{feature}' AS feature, round(sum((a - e) * ln(a / e)), 6) AS psi FROM s)"""


def _ks(feature: str) -> str:
    return f"""(WITH c AS (SELECT {feature} AS v, count(*) FILTER (ts < DATE '{HALF}') AS e, count(*) FILTER (ts >= DATE '{HALF}') AS a FROM clickstream
WHERE {feature} IS NOT NULL GROUP BY 1),
s AS (SELECT CAST(sum(e) OVER (ORDER BY v) AS DOUBLE) / CAST(sum(e) OVER () AS DOUBLE) AS x, CAST(sum(a) OVER (ORDER BY v) AS DOUBLE) / CAST(sum(a) OVER () AS DOUBLE) AS y FROM c)
SELECT '{feature}' AS feature, round(max(abs(x - y)), 6) AS ks FROM s)"""


BOTH = ("dwell_time", "scroll_depth")


@query("r6_stability_index", "clickstream", "SELECT * FROM " + " UNION ALL SELECT * FROM ".join(_psi(f) for f in BOTH))
def _(shop):
    return P.stability_index(*halves(shop), BOTH).withColumn("psi", F.round("psi", 6))


@query("r7_ks_statistic", "clickstream", "SELECT * FROM " + " UNION ALL SELECT * FROM ".join(_ks(f) for f in BOTH))
def _(shop):
    return P.largest_gap(*halves(shop), BOTH).withColumn("ks", F.round("ks", 6))


@query(
    "r8_drift_alerts", "clickstream",
    f"""WITH p AS (SELECT * FROM {_psi(BOTH[0])} UNION ALL SELECT * FROM {_psi(BOTH[1])}), k AS (SELECT * FROM {_ks(BOTH[0])} UNION ALL SELECT * FROM {_ks(BOTH[1])})
SELECT feature, psi, ks, CASE WHEN psi > 0.25e0 OR ks > 0.1e0 THEN 'critical' WHEN psi > 0.1e0 THEN 'warning' ELSE 'none' END AS severity FROM p JOIN k USING (feature)""",
)
def _(shop):
    before, after = halves(shop)
    found = P.drift_alerts(P.stability_index(before, after, BOTH), P.largest_gap(before, after, BOTH))
    return found.withColumns({c: F.round(c, 6) for c in ("psi", "ks")})
