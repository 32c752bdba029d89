"""Queries for the complete feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens.operators import fulltables as T
from shoplens.plans.aggregates import profile_sql
from shoplens.plans.cleaning import DAYS
from shoplens.plans.joins import SESSION
from shoplens.plans.registry import query

USER_CODES, USER_NUMBERS = ["gender", "location", "income_level", "preference_category", "device_type"], T.USER_NUMBERS
PRODUCT_CODES, PRODUCT_NUMBERS = ["category", "brand"], T.PRODUCT_NUMBERS
FACT_CODES, FACT_NUMBERS = ["interaction_type", "preference_category", "category"], T.INTERACTION_NUMBERS
USER_RATES = ["interaction_frequency", "avg_rating_weighted", "spending_power"]


def _codes(columns: list[str]) -> str:
    return ", ".join(f"dense_rank() OVER (ORDER BY coalesce({c}, 'unknown')) - 1 AS {c}_encoded" for c in columns)


def _scaled(columns: list[str]) -> str:
    return ", ".join(
        f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) OVER () ELSE 1 END, 6) AS {c}_scaled" for c in columns
    )


def _shown(df, columns: list[str], rounded: list[str]):
    return df.select(*columns, *[F.round(c, 6).alias(c) for c in rounded])


def _rounded(columns: list[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


@query(
    "e_user_features", "users interactions",
    f"""WITH p AS ({profile_sql('user_id', 'total_spent')}), d AS ({DAYS}),
f AS (SELECT users.*, days_since_created, days_since_active, coalesce(total_interactions, 0) AS total_interactions, coalesce(avg_rating, 0) AS avg_rating,
  coalesce(rating_count, 0) AS rating_count, coalesce(total_spent, 0) AS total_spent, coalesce(avg_order_value, 0) AS avg_order_value,
  avg_dwell_time, total_dwell_time, avg_scroll_depth, max_scroll_depth,
  coalesce(total_interactions, 0) / CAST(greatest(days_since_created, 1) AS DOUBLE) AS interaction_frequency,
  coalesce(avg_rating, 0) * coalesce(rating_count, 0) / greatest(coalesce(rating_count, 0), 1) AS avg_rating_weighted,
  coalesce(total_spent, 0) / greatest(days_since_created, 1) AS spending_power
  FROM users JOIN d USING (user_id) LEFT JOIN p USING (user_id))
SELECT user_id, age, days_since_created, days_since_active, total_interactions, rating_count, total_spent, total_dwell_time, max_scroll_depth,
  {_codes(USER_CODES)}, {_rounded(['avg_rating', 'avg_order_value', 'avg_dwell_time', 'avg_scroll_depth', *USER_RATES])}, {_scaled(USER_NUMBERS)} FROM f""",
)
def _(shop):
    columns = ["user_id", "age", "days_since_created", "days_since_active", "total_interactions", "rating_count", "total_spent", "total_dwell_time", "max_scroll_depth"]
    rounded = ["avg_rating", "avg_order_value", "avg_dwell_time", "avg_scroll_depth", *USER_RATES, *[f"{c}_scaled" for c in USER_NUMBERS]]
    return _shown(T.user_table(shop.users, shop.interactions, shop.now), [*columns, *[f"{c}_encoded" for c in USER_CODES]], rounded)


@query(
    "e_product_features", "products interactions",
    f"""WITH p AS ({profile_sql('product_id', 'total_revenue')}),
f AS (SELECT products.*, coalesce(total_interactions, 0) AS total_interactions, coalesce(avg_rating, 0) AS avg_rating, coalesce(rating_count, 0) AS rating_count,
  coalesce(total_revenue, 0) AS total_revenue, avg_dwell_time, avg_scroll_depth,
  0.4e0 * coalesce(total_interactions, 0) + 0.3e0 * coalesce(avg_rating, 0) + 0.3e0 * coalesce(rating_count, 0) AS popularity_score,
  0.5e0 * avg_dwell_time + 0.5e0 * avg_scroll_depth AS engagement_score, discount_percentage / 100e0 AS discount_impact,
  CASE WHEN price <= 0 THEN NULL WHEN price <= 50 THEN 'budget' WHEN price <= 200 THEN 'affordable' WHEN price <= 500 THEN 'mid-range'
    WHEN price <= 1000 THEN 'premium' ELSE 'luxury' END AS price_category
  FROM products LEFT JOIN p USING (product_id))
SELECT product_id, total_interactions, rating_count, total_revenue, price_category, {_codes(PRODUCT_CODES)},
  {_rounded(['avg_rating', 'avg_dwell_time', 'avg_scroll_depth', 'popularity_score', 'engagement_score', 'discount_impact'])}, {_scaled(PRODUCT_NUMBERS)} FROM f""",
)
def _(shop):
    rounded = ["avg_rating", "avg_dwell_time", "avg_scroll_depth", "popularity_score", "engagement_score", "discount_impact", *[f"{c}_scaled" for c in PRODUCT_NUMBERS]]
    columns = ["product_id", "total_interactions", "rating_count", "total_revenue", "price_category", *[f"{c}_encoded" for c in PRODUCT_CODES]]
    return _shown(T.product_table(shop.products, shop.interactions), columns, rounded)


@query(
    "d_interaction_features", "users products interactions",
    f"""WITH s AS ({SESSION}),
f AS (SELECT i.*, u.age, u.income_level, u.preference_category, u.device_type, p.category, p.brand, p.price, p.rating AS product_rating,
  session_length, unique_products, session_value FROM interactions i LEFT JOIN users u USING (user_id) LEFT JOIN products p USING (product_id) JOIN s USING (session_id))
SELECT user_id, product_id, session_id, line, age, product_rating, session_length, unique_products, session_value, interaction_type = 'purchase' AS is_purchase,
  interaction_type = 'view' AS is_view, interaction_type = 'add_to_cart' AS is_cart, interaction_type = 'review' AS is_review,
  CAST(hour(ts) AS INT) AS hour_of_day, CAST(isodow(ts) - 1 AS INT) AS day_of_week, isodow(ts) >= 6 AS is_weekend, hour(ts) BETWEEN 9 AND 17 AS is_business_hours,
  coalesce(preference_category = category, false) AS category_match,
  CASE WHEN price <= CASE income_level WHEN 'low' THEN 100 WHEN 'medium' THEN 500 WHEN 'high' THEN 1000 END THEN 1 ELSE 0 END AS price_affordability,
  {_codes(FACT_CODES)}, {_scaled(FACT_NUMBERS)} FROM f""",
)
def _(shop):
    columns = [
        "user_id", "product_id", "session_id", "line", "age", "product_rating", "session_length", "unique_products", "session_value", *T.TYPES, "hour_of_day",
        "day_of_week", "is_weekend", "is_business_hours", "category_match", "price_affordability", *[f"{c}_encoded" for c in FACT_CODES],
    ]
    return _shown(T.interaction_table(shop.interactions, shop.users, shop.products), columns, [f"{c}_scaled" for c in FACT_NUMBERS])
