"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens.functions.scalars import stamp
from shoplens.operators import aggregates as A
from shoplens.operators import baskets as B
from shoplens.operators.cleaning import add_ages
from shoplens.operators.joins import attach_stats
from shoplens.plans.baskets import RULES, user_baskets
from shoplens.plans.cleaning import DAYS
from shoplens.plans.joins import SESSION
from shoplens.plans.registry import query


def profile_sql(key: str, amount: str) -> str:
    return f"""SELECT {key}, count(*) AS total_interactions, avg(rating) AS avg_rating, count(rating) AS rating_count,
CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS {amount},
CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) / count(total_amount) AS avg_order_value,
avg(dwell_time) AS avg_dwell_time, CAST(sum(dwell_time) AS BIGINT) AS total_dwell_time, avg(scroll_depth) AS avg_scroll_depth,
max(scroll_depth) AS max_scroll_depth, min(ts) AS first_interaction, max(ts) AS last_interaction FROM interactions GROUP BY 1"""


TIMES = "* REPLACE (strftime(first_interaction, '%Y-%m-%d %H:%M:%S') AS first_interaction, strftime(last_interaction, '%Y-%m-%d %H:%M:%S') AS last_interaction)"


def _stamped(df):
    return df.withColumns({c: stamp(c) for c in ("first_interaction", "last_interaction")})


@query("e1_user_profile", "interactions", f"SELECT {TIMES} FROM ({profile_sql('user_id', 'total_spent')})")
def _(shop):
    return _stamped(A.interaction_profile(shop.interactions, "user_id"))


@query("e2_product_profile", "interactions", f"SELECT {TIMES} FROM ({profile_sql('product_id', 'total_revenue')})")
def _(shop):
    return _stamped(A.interaction_profile(shop.interactions, "product_id", "total_revenue"))


@query("e3_session_profile", "interactions", SESSION)
def _(shop):
    return A.session_profile(shop.interactions)


ZERO = ["total_interactions", "avg_rating", "rating_count", "total_spent", "avg_order_value"]


def user_features(shop):
    profile = A.interaction_profile(shop.interactions, "user_id")
    return A.user_rates(attach_stats(add_ages(shop.users, shop.now), profile, "user_id", ZERO))


def product_features(shop):
    profile = A.interaction_profile(shop.interactions, "product_id", "total_revenue")
    zero = ["total_interactions", "avg_rating", "rating_count", "total_revenue"]
    return A.product_scores(attach_stats(shop.products, profile, "product_id", zero))


@query(
    "e4_user_rates", "users interactions",
    f"""WITH p AS ({profile_sql('user_id', 'total_spent')}), d AS ({DAYS})
SELECT d.user_id, coalesce(total_interactions, 0) / CAST(greatest(days_since_created, 1) AS DOUBLE) AS interaction_frequency,
coalesce(avg_rating, 0) * coalesce(rating_count, 0) / greatest(coalesce(rating_count, 0), 1) AS avg_rating_weighted,
coalesce(total_spent, 0) / greatest(days_since_created, 1) AS spending_power FROM d LEFT JOIN p USING (user_id)""",
)
def _(shop):
    return user_features(shop).select("user_id", "interaction_frequency", "avg_rating_weighted", "spending_power")


PRODUCT_SCORES = f"""WITH p AS ({profile_sql('product_id', 'total_revenue')})
SELECT products.product_id, 0.4e0 * coalesce(total_interactions, 0) + 0.3e0 * coalesce(avg_rating, 0) + 0.3e0 * coalesce(rating_count, 0)
AS popularity_score, 0.5e0 * avg_dwell_time + 0.5e0 * avg_scroll_depth AS engagement_score FROM products LEFT JOIN p USING (product_id)"""


@query("e5_popularity_score", "products interactions", f"SELECT product_id, popularity_score FROM ({PRODUCT_SCORES})")
def _(shop):
    return product_features(shop).select("product_id", "popularity_score")


@query("e6_engagement_score", "products interactions", f"SELECT product_id, engagement_score FROM ({PRODUCT_SCORES})")
def _(shop):
    return product_features(shop).select("product_id", "engagement_score")


@query("e7_value_counts", "interactions", "SELECT interaction_type, count(*) AS n FROM interactions GROUP BY 1")
def _(shop):
    return A.value_counts(shop.interactions, "interaction_type")


FUNNEL_SQL = ", ".join(
    f"count(*) FILTER (event_type = '{t}') AS {t}_count" for t in ("view", "click", "add_to_cart", "purchase")
)
RATES = """CASE WHEN view_count > 0 THEN click_count / view_count ELSE 0e0 END AS view_to_click_rate,
CASE WHEN click_count > 0 THEN add_to_cart_count / click_count ELSE 0e0 END AS click_to_cart_rate,
CASE WHEN add_to_cart_count > 0 THEN purchase_count / add_to_cart_count ELSE 0e0 END AS cart_to_purchase_rate"""
ENGAGED = "view_count * 0.1e0 + click_count * 0.3e0 + add_to_cart_count * 0.5e0 + purchase_count * 1.0e0 AS user_engagement_score"


@query("e8_funnel_counts", "clickstream", f"SELECT product_id, {FUNNEL_SQL} FROM clickstream GROUP BY 1")
def _(shop):
    return A.funnel_counts(shop.clickstream, ["product_id"])


@query("e9_funnel_rates", "clickstream", f"SELECT product_id, {RATES} FROM (SELECT product_id, {FUNNEL_SQL} FROM clickstream GROUP BY 1)")
def _(shop):
    rated = A.funnel_rates(A.funnel_counts(shop.clickstream, ["product_id"]))
    return rated.select("product_id", "view_to_click_rate", "click_to_cart_rate", "cart_to_purchase_rate")


@query("e10_weighted_engagement", "clickstream", f"SELECT product_id, {ENGAGED} FROM (SELECT product_id, {FUNNEL_SQL} FROM clickstream GROUP BY 1)")
def _(shop):
    scored = A.weighted_engagement(A.funnel_counts(shop.clickstream, ["product_id"]))
    return scored.select("product_id", "user_engagement_score")


@query("e11_audience", "clickstream", "SELECT product_id, count(DISTINCT user_id) AS unique_users FROM clickstream GROUP BY 1")
def _(shop):
    return A.audience(shop.clickstream, "product_id")


@query(
    "e11_overall_audience", "clickstream",
    "SELECT count(DISTINCT user_id) AS unique_users, count(DISTINCT product_id) AS unique_products FROM clickstream",
)
def _(shop):
    return A.audience(shop.clickstream)


DISTRIBUTIONS = """SELECT distribution, string_agg(k || ':' || n, ',' ORDER BY k) AS counts FROM (
  SELECT 'event_type' AS distribution, event_type AS k, count(*) AS n FROM clickstream GROUP BY 2
  UNION ALL SELECT 'device_type', device_type, count(*) FROM clickstream GROUP BY 2
  UNION ALL SELECT 'hour', strftime(ts, '%H'), count(*) FROM clickstream GROUP BY 2) GROUP BY 1"""


@query("e12_distributions", "clickstream", DISTRIBUTIONS)
def _(shop):
    return A.distributions(shop.clickstream)


@query(
    "e13_matrix_statistics", "interactions",
    f"""WITH {RULES}, n AS (SELECT count(*) AS items FROM freq)
SELECT max(items) AS items, round(sum(jaccard) / (max(items) * max(items)), 9) AS mean_score, greatest(max(jaccard), 0) AS max_score,
count(*) FILTER (jaccard <> 0) AS non_zero FROM rules, n""",
)
def _(shop):
    baskets = user_baskets(shop)
    n = B.frequencies(baskets).agg(F.count(F.lit(1)).alias("n")).scalar()
    return A.matrix_statistics(B.jaccard(baskets, B.cooccurrence(baskets)), n)


@query(
    "e16_rollups", "clickstream",
    """SELECT user_id, product_id, CASE WHEN grouping(user_id) = 0 THEN 'user' WHEN grouping(product_id) = 0 THEN 'product'
ELSE 'global' END AS level, count(*) AS events, count(*) FILTER (event_type = 'purchase') AS purchases,
CAST(sum(CAST(dwell_time AS DECIMAL(18,2))) AS DOUBLE) AS dwell_time FROM clickstream
GROUP BY GROUPING SETS ((user_id), (product_id), ())""",
)
def _(shop):
    return A.rollups(shop.clickstream)
