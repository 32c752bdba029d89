"""Feature-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens.functions.scalars import stamp
from shoplens.operators import clickstream as C
from shoplens.operators import featuretable as T
from shoplens.plans.aggregates import ENGAGED, FUNNEL_SQL, RATES
from shoplens.plans.clickstream import FOLD, MINUTES, SESSIONS
from shoplens.plans.registry import query

# One stored row per user and day, and per product and day, at the last event of the day.
TABLE = """
daily AS (SELECT 'user' AS entity_type, user_id AS entity_id, max(ts) AS stored_at, count(*) AS n, 3600 AS ttl FROM clickstream GROUP BY user_id, CAST(ts AS DATE)
  UNION ALL SELECT 'product', product_id, max(ts), count(*), 7200 FROM clickstream GROUP BY product_id, CAST(ts AS DATE)),
feature_table AS (SELECT *, stored_at + ttl * INTERVAL 1 SECOND AS expires_at FROM daily)"""
AS_OF = "TIMESTAMP '2024-01-30 22:00:00'"


def feature_table(shop):
    parts = []
    for entity, key in (("user", "user_id"), ("product", "product_id")):
        daily = shop.clickstream.groupBy(key, F.to_date("ts").alias("day")).agg(F.max("ts").alias("at"), F.count(F.lit(1)).alias("total_events"))
        parts.append(T.stored(daily, entity, key, ["total_events"], F.col("at")))
    return parts[0].unionByName(parts[1])


def moment(text="2024-01-30 22:00:00"):
    return F.lit(text).cast("timestamp")


def readable(df):
    out = df.withColumn("total_events", F.element_at("features", "total_events").cast("long"))
    return out.withColumns({c: stamp(c) for c in ("stored_at", "expires_at")})


COLUMNS = ["entity_type", "entity_id", "stored_at", "expires_at", "total_events"]
TEXT = "strftime(stored_at, '%Y-%m-%d %H:%M:%S') AS stored_at, strftime(expires_at, '%Y-%m-%d %H:%M:%S') AS expires_at"
LIVE = TABLE + f""",
live AS (SELECT * FROM feature_table WHERE stored_at <= {AS_OF} AND expires_at > {AS_OF}
  QUALIFY row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY stored_at DESC) = 1)"""
IDS = "SELECT 'user' AS entity_type, user_id AS entity_id FROM users UNION ALL SELECT 'product', product_id FROM products"


def ids(shop):
    return shop.users.select(F.lit("user").alias("entity_type"), F.col("user_id").alias("entity_id")).unionByName(
        shop.products.select(F.lit("product").alias("entity_type"), F.col("product_id").alias("entity_id"))
    )


@query("q1_stored_features", "clickstream", f"WITH {TABLE} SELECT entity_type, entity_id, {TEXT}, n AS total_events FROM feature_table")
def _(shop):
    return readable(feature_table(shop)).select(*COLUMNS)


@query(
    "q2_live_lookup", "clickstream users products",
    f"WITH {LIVE}, ids AS ({IDS}) SELECT entity_type, entity_id, {TEXT}, n AS total_events FROM ids LEFT JOIN live USING (entity_type, entity_id)",
)
def _(shop):
    return readable(T.lookup_ids(feature_table(shop), ids(shop), moment())).select(*COLUMNS)


@query(
    "q3_patch", "clickstream users products",
    f"""WITH {LIVE} SELECT entity_type, entity_id, strftime(expires_at, '%Y-%m-%d %H:%M:%S') AS expires_at, n AS total_events, entity_id % 7 AS grade
FROM live JOIN ({IDS}) USING (entity_type, entity_id)""",
)
def _(shop):
    patches = ids(shop).withColumn("changes", F.create_map(F.lit("grade"), (F.col("entity_id") % 7).cast("double")))
    out = T.patch(feature_table(shop), patches, moment())
    return out.select(
        "entity_type", "entity_id", stamp("expires_at").alias("expires_at"), F.element_at("features", "total_events").cast("long").alias("total_events"),
        F.element_at("features", "grade").cast("long").alias("grade"),
    )


@query(
    "q4_statistics", "clickstream",
    f"""WITH {TABLE} SELECT entity_type, count(*) AS rows, count(DISTINCT entity_id) AS entities, count(*) FILTER (expires_at > {AS_OF}) AS live_rows
FROM feature_table GROUP BY 1""",
)
def _(shop):
    return T.statistics(feature_table(shop), moment())


@query(
    "q5_expired_cleanup", "clickstream",
    f"""WITH {TABLE} SELECT entity_type, count(*) FILTER (expires_at <= TIMESTAMP '2024-01-15') AS removed,
count(*) FILTER (expires_at > TIMESTAMP '2024-01-15') AS kept FROM feature_table GROUP BY 1""",
)
def _(shop):
    return T.expired_counts(feature_table(shop), moment("2024-01-15"))


@query(
    "q5_remaining_rows", "clickstream",
    f"WITH {TABLE} SELECT entity_type, entity_id, {TEXT}, n AS total_events FROM feature_table WHERE expires_at > TIMESTAMP '2024-01-15'",
)
def _(shop):
    return readable(T.without_expired(feature_table(shop), moment("2024-01-15"))).select(*COLUMNS)


@query(
    "q6_online_user_features", "clickstream",
    FOLD.format(key="user_id") + f""", {SESSIONS}, c AS (SELECT user_id, {FUNNEL_SQL}, count(*) FILTER (device_type = 'mobile') AS m,
count(*) FILTER (device_type = 'desktop') AS dk, count(*) FILTER (device_type = 'tablet') AS t FROM clickstream GROUP BY 1),
s AS (SELECT user_id, count(*) AS session_count, avg({MINUTES}) AS a FROM sessions GROUP BY 1)
SELECT user_id, view_count AS total_views, click_count AS total_clicks, add_to_cart_count AS total_adds_to_cart, purchase_count AS total_purchases,
round(coalesce(d, 0), 9) AS avg_dwell_time, round(coalesce(s.a, 0), 6) AS avg_session_duration, round(coalesce(f.s, 0), 9) AS avg_scroll_depth, session_count,
m AS device_preference_mobile, dk AS device_preference_desktop, t AS device_preference_tablet
FROM c LEFT JOIN (SELECT * FROM f WHERE n = total) f ON f.k = user_id LEFT JOIN s USING (user_id)""",
)
def _(shop):
    out = T.online_user_features(shop.clickstream)
    return out.withColumns({c: F.round(c, 6 if "session" in c else 9) for c in ("avg_dwell_time", "avg_scroll_depth", "avg_session_duration")})


@query(
    "q6_online_product_features", "clickstream",
    FOLD.format(key="product_id") + f""", c AS (SELECT product_id, {FUNNEL_SQL} FROM clickstream GROUP BY 1)
SELECT product_id, view_count AS total_views, click_count AS total_clicks, add_to_cart_count AS total_adds_to_cart, purchase_count AS total_purchases,
{RATES}, {ENGAGED}, round(coalesce(d, 0), 9) AS avg_dwell_time, round(coalesce(s, 0), 9) AS avg_scroll_depth
FROM c LEFT JOIN (SELECT * FROM f WHERE n = total) f ON f.k = product_id""",
)
def _(shop):
    out = T.online_product_features(shop.clickstream)
    return out.withColumns({c: F.round(c, 9) for c in ("avg_dwell_time", "avg_scroll_depth")})


@query(
    "q7_point_in_time", "clickstream",
    """WITH fx AS (SELECT user_id, ts, max(dwell_time) AS dwell_time FROM clickstream WHERE event_type = 'view' AND dwell_time IS NOT NULL GROUP BY 1, 2)
SELECT c.event_id, c.user_id, strftime(c.ts, '%Y-%m-%d %H:%M:%S') AS ts, fx.dwell_time AS dwell_time_as_of
FROM (SELECT * FROM clickstream WHERE event_type = 'purchase') c ASOF LEFT JOIN fx ON fx.user_id = c.user_id AND fx.ts <= c.ts""",
)
def _(shop):
    facts = shop.clickstream.where("event_type = 'purchase'")
    features = shop.clickstream.where("event_type = 'view' AND dwell_time IS NOT NULL")
    out = T.as_of_features(facts, features, "user_id", "ts", "ts", "dwell_time", "event_id")
    return out.withColumn("ts", stamp("ts"))


@query(
    "q8_recent_categories", "interactions products",
    """WITH c AS (SELECT user_id, category, count(*) AS n FROM interactions JOIN products USING (product_id) WHERE ts > TIMESTAMP '2001-12-01' - INTERVAL 400 DAY GROUP BY 1, 2)
SELECT user_id, string_agg(category || ':' || n, ',' ORDER BY category) AS recent_category_counts FROM c GROUP BY 1""",
)
def _(shop):
    return T.recent_categories(shop.interactions, shop.products, shop.now, days=400)


@query(
    "q9_preferred_category", "interactions products",
    """WITH c AS (SELECT user_id, category, count(*) AS n FROM interactions JOIN products USING (product_id) GROUP BY 1, 2)
SELECT user_id, category AS preferred_category FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, category) = 1""",
)
def _(shop):
    return T.preferred_category(shop.interactions, shop.products)


@query(
    "q10_filled_items", "raw_interactions products",
    """WITH p AS (SELECT product_id, category, CASE WHEN product_id % 9 <> 0 THEN price END AS price FROM products),
r AS (SELECT product_id, avg(rating) AS r FROM raw_interactions WHERE rating IS NOT NULL GROUP BY 1),
m AS (SELECT category, avg(r) AS cr, median(price) AS cp FROM p LEFT JOIN r USING (product_id) GROUP BY 1)
SELECT product_id, category, round(coalesce(r, cr), 6) AS item_rating, round(coalesce(price, cp), 6) AS price FROM p LEFT JOIN r USING (product_id) JOIN m USING (category)""",
)
def _(shop):
    gaps = shop.products.withColumn("price", F.when(F.col("product_id") % 9 != 0, F.col("price"))).select("product_id", "category", "price")
    out = T.filled_items(gaps, shop.raw_interactions)
    return out.withColumns({c: F.round(c, 6) for c in ("item_rating", "price")})


@query(
    "q11_activity", "clickstream",
    """WITH e AS (SELECT *, (epoch(TIMESTAMP '2024-01-31') - epoch(date_trunc('second', ts))) / 86400e0 AS age,
CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 3 WHEN 'add_to_cart' THEN 5 WHEN 'purchase' THEN 10 ELSE 0 END AS w FROM clickstream),
g AS (SELECT product_id, max(ts) AS l, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'view') AS v,
  sum(CASE WHEN age BETWEEN 0 AND 7 THEN w ELSE 0 END) AS nw, sum(CASE WHEN age > 7 AND age <= 14 THEN w ELSE 0 END) AS old FROM e GROUP BY 1)
SELECT product_id, (epoch(TIMESTAMP '2024-01-31') - epoch(date_trunc('second', l))) / 3600e0 AS activity_recency_hours,
CASE WHEN v > 0 THEN p / v ELSE 0e0 END AS conversion_rate, CASE WHEN old > 0 THEN CAST(nw AS DOUBLE) / CAST(old AS DOUBLE) ELSE 0e0 END AS trending_score FROM g""",
)
def _(shop):
    return T.activity(shop.clickstream, shop.stream_now)


@query(
    "q12_price_sensitivity", "interactions products",
    """WITH c AS (SELECT CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) / count(price) AS m FROM products)
SELECT user_id, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) / count(*) / (SELECT m FROM c) AS price_sensitivity
FROM interactions JOIN products USING (product_id) GROUP BY 1""",
)
def _(shop):
    return T.price_sensitivity(shop.interactions, shop.products)


@query(
    "q12_season_and_share", "interactions products",
    """WITH m AS (SELECT product_id, month(ts) AS mo, count(*) AS n FROM interactions GROUP BY 1, 2),
b AS (SELECT product_id, CAST(sum(n) AS BIGINT) AS n, max(n) / (CAST(sum(n) AS DOUBLE) / 12e0) AS seasonal_trend FROM m GROUP BY 1),
k AS (SELECT product_id, category, price, coalesce(n, 0) AS n, coalesce(seasonal_trend, 0) AS seasonal_trend FROM products LEFT JOIN b USING (product_id)),
s AS (SELECT category, CAST(sum(n) AS BIGINT) AS cn FROM k GROUP BY 1)
SELECT product_id, CASE WHEN price <= 0 THEN NULL WHEN price <= 50 THEN 'budget' WHEN price <= 200 THEN 'affordable' WHEN price <= 500 THEN 'mid-range'
WHEN price <= 1000 THEN 'premium' ELSE 'luxury' END AS price_tier, seasonal_trend, n / cn AS category_popularity FROM k JOIN s USING (category)""",
)
def _(shop):
    return T.season_and_share(shop.interactions, shop.products)
