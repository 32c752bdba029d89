"""The complete user, product and interaction feature tables, each as one result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.functions.scalars import price_tier, weekday_flags
from shoplens.operators import aggregates as A
from shoplens.operators.cleaning import add_ages
from shoplens.operators.encoders import affordable, apply_scaler, encode_labels, fit_scaler
from shoplens.operators.joins import attach_group, attach_stats

USER_LABELS = ["gender", "location", "income_level", "preference_category", "device_type", "language_preference", "timezone"]
USER_NUMBERS = ["age", "total_interactions", "avg_rating", "total_spent", "interaction_frequency"]
PRODUCT_LABELS = ["category", "subcategory", "brand", "color", "size", "availability_status"]
PRODUCT_NUMBERS = ["price", "rating", "review_count", "stock_quantity", "popularity_score"]
INTERACTION_LABELS = ["interaction_type", "payment_method", "preference_category", "category", "subcategory"]
INTERACTION_NUMBERS = ["rating", "quantity", "total_amount", "dwell_time", "scroll_depth"]
TYPES = {"is_purchase": "purchase", "is_view": "view", "is_cart": "add_to_cart", "is_review": "review"}


def _encoded(df: DataFrame, labels: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Codes of the text columns and scaled forms of the number columns that the table has."""
    texts = dict(df.dtypes)
    df = encode_labels(df, [c for c in labels if texts.get(c) == "string"])
    present = [c for c in numbers if c in df.columns]
    return apply_scaler(df, fit_scaler(df, present), present)


def user_table(users: DataFrame, interactions: DataFrame, as_of: Column) -> DataFrame:
    """Users with their interaction profile, per-day rates, codes and scaled numbers."""
    profile = A.interaction_profile(interactions, "user_id")
    zero = ["total_interactions", "avg_rating", "rating_count", "total_spent", "avg_order_value"]
    return _encoded(A.user_rates(attach_stats(add_ages(users, as_of), profile, "user_id", zero)), USER_LABELS, USER_NUMBERS)


def product_table(products: DataFrame, interactions: DataFrame) -> DataFrame:
    """Products with their interaction profile, scores, price band, discount share, codes and scaled numbers."""
    profile = A.interaction_profile(interactions, "product_id", "total_revenue")
    zero = ["total_interactions", "avg_rating", "rating_count", "total_revenue"]
    known = A.product_scores(attach_stats(products, profile, "product_id", zero)).withColumns(
        {"price_category": price_tier(F.col("price")), "discount_impact": F.col("discount_percentage") / F.lit(100.0)}
    )
    return _encoded(known, PRODUCT_LABELS, PRODUCT_NUMBERS)


def interaction_table(interactions: DataFrame, users: DataFrame, products: DataFrame) -> DataFrame:
    """Interactions with user and product attributes, type and clock flags, fit of category and price, session statistics,
    codes and scaled numbers. The product's rating is product_rating."""
    who = users.select(*[c for c in ("user_id", "age", "income_level", "preference_category", "device_type") if c in users.columns])
    what = products.select(*[c for c in ("product_id", "category", "subcategory", "brand", "price", "rating") if c in products.columns])
    rows = interactions.join(who, "user_id", "left").join(what.withColumnRenamed("rating", "product_rating"), "product_id", "left")
    clock = weekday_flags(F.col("ts"))
    rows = rows.withColumns(
        {
            **{name: F.col("interaction_type") == kind for name, kind in TYPES.items()},
            **{name: clock[name] for name in ("hour_of_day", "day_of_week", "is_weekend", "is_business_hours")},
            "category_match": F.coalesce(F.col("preference_category") == F.col("category"), F.lit(False)),
            "price_affordability": affordable(F.col("price"), F.col("income_level")),
        }
    )
    return _encoded(attach_group(rows, A.session_profile(interactions), "session_id"), INTERACTION_LABELS, INTERACTION_NUMBERS)
