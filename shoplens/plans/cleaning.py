"""Scan, sink and cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens.functions.ordered import exact_median
from shoplens.functions.scalars import stamp, weekday_flags
from shoplens.operators import cleaning as C
from shoplens.plans.registry import query
from shoplens.sources import sinks
from shoplens.sources.tables import read_csv, read_parquet, within_age
from shoplens import schemas

PRODUCT_COLUMNS = "product_id, name, category, brand, price, rating, review_count"
CLEAN_PRODUCTS = """
numbers AS (SELECT product_id, trim(name) AS name, category, brand, discount_percentage,
  TRY_CAST(price AS DOUBLE) AS price, rating, coalesce(review_count, 0) AS review_count,
  coalesce(stock_quantity, 0) AS stock_quantity FROM raw_products),
cleaned AS (SELECT * REPLACE (coalesce(price, (SELECT median(price) FROM numbers)) AS price,
  coalesce(rating, (SELECT median(rating) FROM numbers)) AS rating) FROM numbers),
valid AS (SELECT * FROM cleaned WHERE price > 0 AND rating BETWEEN 0 AND 5)"""
ZERO_RATED = "SELECT * REPLACE (coalesce(rating, 0) AS rating) FROM interactions"


@query("a1_parquet_scan", sql="SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def _(shop):
    return shop.table("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


@query("a2_scan_with_csv_fallback", "users", "SELECT user_id, age, gender, location, email FROM users")
def _(shop):
    from shoplens.sources.tables import read_table

    folder = sinks.run_folder(shop.spark, "csv")
    columns = [f.name for f in schemas.USERS if f.name in shop.users.columns]
    sinks.write_table(shop.users.select(*columns), folder, "users", fmt="csv")
    stored = type(schemas.USERS)([schemas.USERS[c] for c in columns])
    return read_table(shop.spark, folder, "users", stored).select("user_id", "age", "gender", "location", "email")


@query("a2_scan_prefers_parquet", "users", "SELECT user_id, age, gender, location, email FROM users")
def _(shop):
    """Where both are there, the CSV file, which here lacks every other row, is not read."""
    from shoplens.sources.tables import read_table

    folder = sinks.run_folder(shop.spark, "both")
    columns = [f.name for f in schemas.USERS if f.name in shop.users.columns]
    users = shop.users.select(*columns)
    sinks.write_table(users.where("user_id % 2 = 0"), folder, "users", fmt="csv")
    sinks.write_table(users, folder, "users")
    stored = type(schemas.USERS)([schemas.USERS[c] for c in columns])
    return read_table(shop.spark, folder, "users", stored).select("user_id", "age", "gender", "location", "email")


@query(
    "a3_parquet_sink", "users raw_users products raw_products",
    f"""WITH {CLEAN_PRODUCTS} SELECT 'products' AS table_name, count(*) AS rows, sum(product_id)::BIGINT AS key_sum FROM valid
UNION ALL SELECT 'users', count(*), sum(user_id)::BIGINT FROM raw_users""",
)
def _(shop):
    folder = sinks.run_folder(shop.spark, "cleaned")
    keys = {"users": "user_id", "products": "product_id"}
    sinks.write_stage(
        {"users": C.clean_users(shop.raw_users, shop.now), "products": C.clean_products(shop.raw_products)}, folder, "cleaned"
    )
    parts = [
        read_parquet(shop.spark, f"{folder}/{name}/{name}_cleaned.parquet").agg(
            F.count(F.lit(1)).alias("rows"), F.sum(key).alias("key_sum")
        ).select(F.lit(name).alias("table_name"), "rows", "key_sum")
        for name, key in keys.items()
    ]
    return parts[0].unionByName(parts[1])


@query(
    "a4_csv_sink", "products",
    "SELECT product_id, name, price, rating, brand AS first_tag, 2 AS n_tags FROM products",
)
def _(shop):
    tagged = shop.products.select("product_id", "name", "price", "rating", F.array("brand", "category").alias("tags"))
    folder = sinks.run_folder(shop.spark, "csv")
    sinks.write_table(tagged, folder, "products", fmt="both")
    back = read_csv(shop.spark, f"{folder}/products/products.csv", tagged.schema)
    return back.select("product_id", "name", "price", "rating", F.col("tags")[0].alias("first_tag"), F.size("tags").alias("n_tags"))


@query(
    "a5_metadata_sink",
    sql="""SELECT 'customer' AS table_name, count(*) AS rows FROM customer UNION ALL SELECT 'events', count(*) FROM events
UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders
UNION ALL SELECT 'part', count(*) FROM part""",
)
def _(shop):
    counts = None
    for name in ("customer", "events", "lineitem", "orders", "part"):
        part = shop.table(name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        counts = part if counts is None else counts.unionByName(part)
    stored = sinks.write_metadata(shop.spark, sinks.run_folder(shop.spark, "meta"), counts, {"format": "parquet"})
    return stored.select(F.explode("row_counts").alias("table_name", "rows"))


@query(
    "a11_retention", "clickstream",
    "SELECT event_id, user_id, event_type FROM clickstream WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY",
)
def _(shop):
    """Events lie in one folder per day; expired days are dropped, and the last one in part is filtered."""
    folder, days = sinks.run_folder(shop.spark, "daily"), schemas.RETENTION_DAYS["events"]
    sinks.write_daily(shop.clickstream, "ts", folder)
    sinks.drop_expired_days(shop.spark, folder, shop.stream_now, days)
    return within_age(shop.spark.read.parquet(folder), "ts", shop.stream_now, days, day="day").select("event_id", "user_id", "event_type")


@query(
    "b1_median_imputation", "users raw_users",
    "SELECT user_id, coalesce(CAST(age AS DOUBLE), (SELECT median(age) FROM raw_users)) AS age FROM raw_users",
)
def _(shop):
    return C.fill_median(shop.raw_users, ["age"]).select("user_id", "age")


@query(
    "b2_constant_imputation", "users raw_users",
    """SELECT user_id, coalesce(gender, 'unknown') AS gender, coalesce(location, 'Unknown') AS location,
coalesce(income_level, 'medium') AS income_level FROM raw_users""",
)
def _(shop):
    return C.fill_constants(shop.raw_users, C.USER_DEFAULTS).select("user_id", "gender", "location", "income_level")


@query("b3_trim", "products raw_products", "SELECT product_id, trim(name) AS name, trim(brand) AS brand FROM raw_products")
def _(shop):
    return C.trim_columns(shop.raw_products, ["name", "brand"]).select("product_id", "name", "brand")


@query(
    "b4_title_case", "users raw_users",
    """SELECT user_id, upper(substr(trim(location), 1, 1)) || substr(trim(location), 2) AS location FROM raw_users""",
)
def _(shop):
    return shop.raw_users.select("user_id", C.title_case(F.trim("location")).alias("location"))


@query("b5_email", "users raw_users", "SELECT user_id, lower(trim(email)) AS email FROM raw_users")
def _(shop):
    return shop.raw_users.select("user_id", F.lower(F.trim("email")).alias("email"))


@query("b6_to_number", "products raw_products", "SELECT product_id, TRY_CAST(price AS DOUBLE) AS price FROM raw_products")
def _(shop):
    return C.to_number(shop.raw_products, ["price"]).select("product_id", "price")


@query(
    "b7_to_timestamp", "users raw_users",
    "SELECT user_id, strftime(TRY_CAST(created_at AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS created_at FROM raw_users",
)
def _(shop):
    return C.to_time(shop.raw_users, ["created_at"]).select("user_id", stamp("created_at").alias("created_at"))


@query("b8_domain_filters", "products raw_products", f"WITH {CLEAN_PRODUCTS} SELECT {PRODUCT_COLUMNS} FROM valid")
def _(shop):
    return C.clean_products(shop.raw_products).select(*PRODUCT_COLUMNS.split(", "))


DAYS = """SELECT user_id, CAST(floor((epoch(TIMESTAMP '2001-12-01') - epoch(created_at)) / 86400) AS BIGINT) AS days_since_created,
CAST(floor((epoch(TIMESTAMP '2001-12-01') - epoch(last_active)) / 86400) AS BIGINT) AS days_since_active FROM users"""


@query("b9_age_in_days", "users", DAYS)
def _(shop):
    return C.add_ages(shop.users, shop.now).select("user_id", "days_since_created", "days_since_active")


@query("b10_activity_flag", "users", f"SELECT user_id, days_since_active <= 30 AS is_active FROM ({DAYS})")
def _(shop):
    return C.add_ages(shop.users, shop.now).select("user_id", "is_active")


@query(
    "b11_discounts", "products",
    """SELECT product_id, discount_percentage > 0 AS has_discount, price * (1e0 - discount_percentage / 100e0) AS final_price,
discount_percentage / 100e0 AS discount_impact FROM products""",
)
def _(shop):
    return C.add_discounts(shop.products).select("product_id", "has_discount", "final_price", "discount_impact")


@query(
    "b12_calendar", "clickstream",
    """SELECT event_id, CAST(hour(ts) AS INT) AS hour_of_day, CAST(isodow(ts) - 1 AS INT) AS day_of_week,
isodow(ts) IN (6, 7) AS is_weekend FROM clickstream""",
)
def _(shop):
    flags = weekday_flags(F.col("ts"))
    return shop.clickstream.select("event_id", *[flags[c].alias(c) for c in ("hour_of_day", "day_of_week", "is_weekend")])


@query(
    "b13_cleaning_report", "users raw_users products raw_products interactions",
    f"""WITH {CLEAN_PRODUCTS} SELECT 'products' AS table_name, (SELECT count(*) FROM raw_products) AS original_rows,
(SELECT count(*) FROM valid) AS cleaned_rows, true AS timed
UNION ALL SELECT 'users', count(*), count(*), true FROM raw_users
UNION ALL SELECT 'interactions', count(*), count(*) FILTER (quantity > 0 AND rating BETWEEN 0 AND 5), true FROM ({ZERO_RATED})""",
)
def _(shop):
    folder = sinks.run_folder(shop.spark, "cleaned")
    tables = {
        "users": lambda seen: C.clean_users(shop.raw_users, shop.now, seen), "products": lambda seen: C.clean_products(shop.raw_products, observation=seen),
        "interactions": lambda seen: C.clean_interactions(shop.interactions, observation=seen),
    }
    found = C.cleaning_report(shop.spark, tables, lambda name, df: sinks.write_table(df, folder, name, suffix="_cleaned"))
    return found.select("table_name", "original_rows", "cleaned_rows", (F.col("seconds") > 0).alias("timed"))


@query(
    "b14_available_columns", "products raw_products",
    "SELECT product_id, coalesce(rating, 0) AS rating, coalesce(review_count, 0) AS review_count FROM raw_products",
)
def _(shop):
    return C.project_available(shop.raw_products, ["product_id", "age", "rating", "review_count", "dwell_time"])


@query(
    "b15_documents", "users",
    """SELECT user_id, '{"age":' || age || ',"location":"' || location || '","created_at":"' ||
strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '"}' AS document FROM users""",
)
def _(shop):
    return C.as_document(shop.users.select("user_id", "age", "location", "created_at"), "user_id")


@query(
    "b16_rows_of_many_keys", "users interactions",
    """SELECT user_id, product_id, session_id, quantity FROM interactions
WHERE user_id IN (SELECT user_id FROM users WHERE income_level = 'luxury')""",
)
def _(shop):
    rich = C.rows_of(shop.users, "income_level", "luxury")
    return C.rows_of_many(shop.interactions.select("user_id", "product_id", "session_id", "quantity"), rich, "user_id")


@query(
    "b_clean_users", "users raw_users",
    """SELECT user_id, coalesce(CAST(age AS DOUBLE), (SELECT median(age) FROM raw_users)) AS age, coalesce(gender, 'unknown') AS gender,
coalesce(upper(substr(trim(location), 1, 1)) || substr(trim(location), 2), 'Unknown') AS location,
coalesce(income_level, 'medium') AS income_level, trim(preference_category) AS preference_category,
lower(trim(email)) AS email FROM raw_users""",
)
def _(shop):
    columns = ["user_id", "age", "gender", "location", "income_level", "preference_category", "email"]
    return C.clean_users(shop.raw_users, shop.now).select(*columns)


@query(
    "b_clean_products", "products raw_products",
    f"""WITH {CLEAN_PRODUCTS} SELECT product_id, name, category, brand, round(price, 6) AS price, round(rating, 6) AS rating, CAST(review_count AS DOUBLE) AS review_count,
CAST(stock_quantity AS DOUBLE) AS stock_quantity, discount_percentage > 0 AS has_discount, round(price * (1e0 - discount_percentage / 100e0), 6) AS final_price,
discount_percentage / 100e0 AS discount_impact FROM valid""",
)
def _(shop):
    columns = ["product_id", "name", "category", "brand", "price", "rating", "review_count", "stock_quantity", "has_discount", "final_price", "discount_impact"]
    return C.clean_products(shop.raw_products).select(*[F.round(c, 6).alias(c) if c in ("price", "rating", "final_price") else F.col(c) for c in columns])


@query(
    "b_clean_interactions", "interactions",
    f"""SELECT user_id, product_id, session_id, rating, CAST(quantity AS DOUBLE) AS quantity, CAST(hour(ts) AS INT) AS hour_of_day,
CAST(isodow(ts) - 1 AS INT) AS day_of_week FROM ({ZERO_RATED}) WHERE quantity > 0 AND rating BETWEEN 0 AND 5""",
)
def _(shop):
    return C.clean_interactions(shop.interactions).select(
        "user_id", "product_id", "session_id", "rating", "quantity", "hour_of_day", "day_of_week"
    )
