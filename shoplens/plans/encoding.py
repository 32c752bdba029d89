"""Encoder, scaler and bin queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens.functions.scalars import dwell_band, price_tier, scroll_band
from shoplens.operators import encoders as E
from shoplens.plans.registry import query
from shoplens.sources import sinks


def _label(column: str, source: str) -> str:
    return f"""(SELECT {column}, row_number() OVER (ORDER BY {column}) - 1 AS {column}_encoded
FROM (SELECT DISTINCT coalesce({column}, 'unknown') AS {column} FROM {source}))"""


@query(
    "f1_label_encoding", "users raw_users",
    f"""SELECT user_id, gender_encoded, income_level_encoded, location_encoded, device_type_encoded FROM raw_users r
JOIN {_label('gender', 'raw_users')} g ON g.gender = coalesce(r.gender, 'unknown')
JOIN {_label('income_level', 'raw_users')} i ON i.income_level = coalesce(r.income_level, 'unknown')
JOIN {_label('location', 'raw_users')} l ON l.location = coalesce(r.location, 'unknown')
JOIN {_label('device_type', 'raw_users')} d ON d.device_type = coalesce(r.device_type, 'unknown')""",
)
def _(shop):
    columns = ["gender", "income_level", "location", "device_type"]
    source = shop.raw_users.select("user_id", *columns)
    return E.encode_labels(source, columns).select("user_id", *[f"{c}_encoded" for c in columns])


@query(
    "f2_standard_scaling", "products",
    """SELECT product_id, round((price - (SELECT avg(price) FROM products)) / (SELECT stddev_pop(price) FROM products), 6) AS price_scaled,
round((rating - (SELECT avg(rating) FROM products)) / (SELECT stddev_pop(rating) FROM products), 6) AS rating_scaled FROM products""",
)
def _(shop):
    columns = ["price", "rating"]
    scaled = E.apply_scaler(shop.products, E.fit_scaler(shop.products, columns), columns)
    return scaled.select("product_id", *[F.round(f"{c}_scaled", 6).alias(f"{c}_scaled") for c in columns])


@query(
    "f3_stored_encoders", "products",
    f"""SELECT product_id, category_encoded, round((price - (SELECT avg(price) FROM products)) / (SELECT stddev_pop(price) FROM products), 6)
AS price_scaled FROM products JOIN {_label('category', 'products')} c USING (category)""",
)
def _(shop):
    folder = sinks.run_folder(shop.spark, "encoders")
    E.fit_labels(shop.products, ["category"]).write.parquet(f"{folder}/category")
    E.fit_scaler(shop.products, ["price"]).write.parquet(f"{folder}/scaler")
    labels, fitted = shop.spark.read.parquet(f"{folder}/category"), shop.spark.read.parquet(f"{folder}/scaler")
    out = E.apply_scaler(E.apply_labels(shop.products, labels, "category"), fitted, ["price"])
    return out.select("product_id", "category_encoded", F.round("price_scaled", 6).alias("price_scaled"))


@query(
    "f4_price_bins", "products interactions",
    """SELECT product_id, session_id, total_amount, CASE WHEN p <= 0 THEN NULL WHEN p <= 50 THEN 'budget' WHEN p <= 200 THEN 'affordable'
WHEN p <= 500 THEN 'mid-range' WHEN p <= 1000 THEN 'premium' ELSE 'luxury' END AS price_category
FROM (SELECT *, total_amount / 50e0 - 50e0 AS p FROM interactions)""",
)
def _(shop):
    shifted = F.col("total_amount") / F.lit(50.0) - F.lit(50.0)
    return shop.interactions.select("product_id", "session_id", "total_amount", price_tier(shifted).alias("price_category"))


@query(
    "f5_dwell_bins", "clickstream",
    """SELECT event_id, CASE WHEN dwell_time < 10 THEN 'very_short' WHEN dwell_time < 30 THEN 'short' WHEN dwell_time < 120 THEN 'medium'
WHEN dwell_time < 300 THEN 'long' WHEN dwell_time IS NOT NULL THEN 'very_long' END AS dwell_time_category FROM clickstream""",
)
def _(shop):
    return shop.clickstream.select("event_id", dwell_band(F.col("dwell_time")).alias("dwell_time_category"))


@query(
    "f6_scroll_bins", "clickstream",
    """SELECT event_id, CASE WHEN scroll_depth < 25 THEN 'low' WHEN scroll_depth < 50 THEN 'medium' WHEN scroll_depth < 75 THEN 'high'
WHEN scroll_depth IS NOT NULL THEN 'very_high' END AS scroll_depth_category FROM clickstream""",
)
def _(shop):
    return shop.clickstream.select("event_id", scroll_band(F.col("scroll_depth")).alias("scroll_depth_category"))


@query(
    "f7_one_hot", "clickstream",
    """SELECT event_id, CAST(event_type = 'view' AS INT) AS event_type_view, CAST(event_type = 'click' AS INT) AS event_type_click,
CAST(event_type = 'add_to_cart' AS INT) AS event_type_add_to_cart, CAST(event_type = 'purchase' AS INT) AS event_type_purchase,
CAST(device_type = 'mobile' AS INT) AS device_mobile, CAST(device_type = 'desktop' AS INT) AS device_desktop,
CAST(device_type = 'tablet' AS INT) AS device_tablet FROM clickstream""",
)
def _(shop):
    flags = E.one_hot(shop.clickstream)
    return flags.select("event_id", *[c for c in flags.columns if c.startswith(("event_type_", "device_")) and c != "device_type"])


@query(
    "f8_ordinal_income", "users",
    """SELECT user_id, CASE income_level WHEN 'low' THEN 0.2e0 WHEN 'medium' THEN 0.5e0 WHEN 'high' THEN 0.8e0 ELSE 0.5e0 END AS income_code
FROM users""",
)
def _(shop):
    return shop.users.select("user_id", E.income_code(F.col("income_level")).alias("income_code"))


@query(
    "f9_hash_code", "products",
    "SELECT product_id, CAST('0x' || substr(md5(category), 1, 7) AS BIGINT) % 100 / 100e0 AS category_code FROM products",
)
def _(shop):
    return shop.products.select("product_id", E.category_code(F.col("category")).alias("category_code"))


@query(
    "f10_affordability", "users products interactions",
    """SELECT user_id, product_id, session_id, CASE WHEN price <= CASE income_level WHEN 'low' THEN 100 WHEN 'medium' THEN 500
WHEN 'high' THEN 1000 END THEN 1 ELSE 0 END AS price_affordability
FROM interactions JOIN users USING (user_id) JOIN products USING (product_id)""",
)
def _(shop):
    rows = shop.interactions.select("user_id", "product_id", "session_id").join(
        shop.users.select("user_id", "income_level"), "user_id"
    ).join(shop.products.select("product_id", "price"), "product_id")
    return rows.select("user_id", "product_id", "session_id", E.affordable(F.col("price"), F.col("income_level")).alias("price_affordability"))
