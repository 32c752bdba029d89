"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens.operators import quality as Q
from shoplens.plans.registry import query
from shoplens.operators.quality import Rule


def _count(rule: str, condition: str, source: str) -> str:
    return f"SELECT '{rule}' AS rule, count(*) FILTER ({condition}) AS failures FROM {source}"


def evaluated(df, *rules):
    return Q.evaluate(df, "t", rules).select("rule", "failures")


SUITE_SQL = """
checks AS (
  SELECT 'users' AS table_name, n AS total_rows, unnest([
    {'rule': 'columns', 'failures': 1}, {'rule': 'unique:user_id', 'failures': n - ids},
    {'rule': 'unique:email', 'failures': mails - dmails + greatest(n - mails - 1, 0)}, {'rule': 'between:age', 'failures': age},
    {'rule': 'in_set:gender', 'failures': gender}, {'rule': 'in_set:income_level', 'failures': income},
    {'rule': 'not_null:user_id', 'failures': n - known}], recursive := true)
  FROM (SELECT count(*) AS n, count(DISTINCT user_id) AS ids, count(user_id) AS known, count(email) AS mails,
    count(DISTINCT email) AS dmails, count(*) FILTER (NOT coalesce(age BETWEEN 13 AND 100, false)) AS age,
    count(*) FILTER (NOT coalesce(gender IN ('male', 'female', 'other'), false)) AS gender,
    count(*) FILTER (NOT coalesce(income_level IN ('low', 'medium', 'high', 'luxury'), false)) AS income FROM raw_users)
  UNION ALL
  SELECT 'products', n, unnest([
    {'rule': 'columns', 'failures': 1}, {'rule': 'unique:product_id', 'failures': n - ids}, {'rule': 'between:price', 'failures': price},
    {'rule': 'between:discount_percentage', 'failures': disc}, {'rule': 'between:rating', 'failures': rating},
    {'rule': 'between:stock_quantity', 'failures': stock}, {'rule': 'in_set:availability_status', 'failures': n}], recursive := true)
  FROM (SELECT count(*) AS n, count(DISTINCT product_id) AS ids,
    count(*) FILTER (NOT coalesce(TRY_CAST(price AS DOUBLE) >= 0.01, false)) AS price,
    count(*) FILTER (NOT coalesce(discount_percentage BETWEEN 0 AND 100, false)) AS disc,
    count(*) FILTER (NOT coalesce(rating BETWEEN 0 AND 5, false)) AS rating,
    count(*) FILTER (NOT coalesce(stock_quantity >= 0, false)) AS stock FROM raw_products)
  UNION ALL
  SELECT 'interactions', n, unnest([
    {'rule': 'columns', 'failures': 1}, {'rule': 'unique:interaction_id', 'failures': n},
    {'rule': 'in_set:interaction_type', 'failures': kind}, {'rule': 'between:rating', 'failures': rating},
    {'rule': 'between:quantity', 'failures': quantity}, {'rule': 'between:total_amount', 'failures': amount},
    {'rule': 'between:dwell_time', 'failures': dwell}, {'rule': 'between:scroll_depth', 'failures': scroll}], recursive := true)
  FROM (SELECT count(*) AS n,
    count(*) FILTER (NOT coalesce(interaction_type IN ('view', 'click', 'add_to_cart', 'purchase', 'rating', 'review'), false)) AS kind,
    count(*) FILTER (NOT coalesce(rating BETWEEN 1 AND 5, true)) AS rating,
    count(*) FILTER (NOT coalesce(quantity >= 1, false)) AS quantity,
    count(*) FILTER (NOT coalesce(total_amount >= 0.01, false)) AS amount,
    count(*) FILTER (NOT coalesce(dwell_time >= 0, false)) AS dwell,
    count(*) FILTER (NOT coalesce(scroll_depth BETWEEN 0 AND 100, false)) AS scroll FROM interactions)
  UNION ALL
  SELECT 'categories', n, unnest([
    {'rule': 'columns', 'failures': 0}, {'rule': 'unique:category_id', 'failures': n - ids}, {'rule': 'between:level', 'failures': level}],
    recursive := true)
  FROM (SELECT count(*) AS n, count(DISTINCT category_id) AS ids, count(*) FILTER (NOT coalesce(level BETWEEN 1 AND 2, false)) AS level
        FROM categories)),
results AS (SELECT table_name, total_rows, rule, CAST(failures AS BIGINT) AS failures, failures = 0 AS success FROM checks)"""
CATEGORIES_SQL = """
tops AS (SELECT p_type AS name, CAST(row_number() OVER (ORDER BY p_type) AS INT) AS category_id FROM (SELECT DISTINCT p_type FROM part)),
categories AS (
  SELECT category_id, name, CAST(NULL AS INT) AS parent_category, 1 AS level FROM tops
  UNION ALL
  SELECT CAST(category_id * 1000 + CAST(substr(p_brand, 7) AS INT) AS INT), p_type || '/' || p_brand, category_id, 2
  FROM (SELECT DISTINCT p_type, p_brand FROM part) JOIN tops ON name = p_type)"""
VIEWS = "users raw_users products raw_products interactions"


def categories(shop):
    """Two levels: part types, and brands within a type."""
    from shoplens.functions.ordered import dense_index

    parts = shop.products
    tops = dense_index(parts, "category", "n").select(
        (F.col("n") + 1).cast("int").alias("category_id"), F.col("category").alias("name")
    )
    level1 = tops.select(
        "category_id", "name", F.lit(None).cast("int").alias("parent_category"),
        F.concat(F.lit("Products of type "), "name").alias("description"), F.lit(1).alias("level"),
    )
    level2 = parts.select("category", "brand").distinct().join(tops, F.col("name") == F.col("category")).select(
        (F.col("category_id") * 1000 + F.regexp_extract("brand", r"(\d+)", 1).cast("int")).cast("int").alias("category_id"),
        F.concat_ws("/", "category", "brand").alias("name"), F.col("category_id").alias("parent_category"),
        F.concat_ws(" ", F.lit("Brand"), "brand", F.lit("of"), "category").alias("description"), F.lit(2).alias("level"),
    )
    return level1.unionByName(level2)


def suite_results(shop):
    products = shop.raw_products.withColumn("price", F.expr("try_cast(price AS DOUBLE)"))
    parts = {
        "users": shop.raw_users, "products": products, "interactions": shop.interactions, "categories": categories(shop),
    }
    out = None
    for name, df in parts.items():
        rows = Q.evaluate(df, name, Q.SUITES[name])
        out = rows if out is None else out.unionByName(rows)
    return out


@query("c1_columns_match", sql="SELECT 'columns' AS rule, CAST(min(0) AS BIGINT) AS failures FROM part")
def _(shop):
    names = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    return evaluated(shop.table("part"), Rule("columns", values=names))


@query(
    "c2_unique", "interactions",
    "SELECT 'unique:session_id' AS rule, count(session_id) - count(DISTINCT session_id) AS failures FROM interactions",
)
def _(shop):
    return evaluated(shop.interactions, Rule("unique", "session_id"))


@query(
    "c3_between", "users raw_users",
    _count("between:age", "NOT coalesce(age BETWEEN 18 AND 60, false)", "raw_users"),
)
def _(shop):
    return evaluated(shop.raw_users, Rule("between", "age", 18, 60))


@query("c4_in_set", "users raw_users", _count("in_set:gender", "NOT coalesce(gender IN ('male', 'female'), false)", "raw_users"))
def _(shop):
    return evaluated(shop.raw_users, Rule("in_set", "gender", values=("male", "female")))


@query("c5_not_null", "interactions", _count("not_null:rating", "rating IS NULL", "interactions"))
def _(shop):
    return evaluated(shop.interactions, Rule("not_null", "rating"))


@query("c6_expectation_suites", VIEWS, f"WITH {CATEGORIES_SQL}, {SUITE_SQL} SELECT table_name, total_rows, rule, failures, success FROM results")
def _(shop):
    return suite_results(shop).select("table_name", "total_rows", "rule", "failures", "success")


@query(
    "c7_quality_score", VIEWS,
    f"""WITH {CATEGORIES_SQL}, {SUITE_SQL} SELECT table_name, CAST(count(*) FILTER (success) AS DOUBLE) / count(*) AS quality_score
FROM results GROUP BY 1""",
)
def _(shop):
    return Q.summarise(suite_results(shop)).select("table_name", "quality_score")


@query(
    "c8_validation_results", VIEWS,
    f"""WITH {CATEGORIES_SQL}, {SUITE_SQL}, s AS (SELECT table_name, max(total_rows) AS total_rows,
CAST(count(*) FILTER (success) AS DOUBLE) / count(*) AS quality_score,
coalesce(string_agg('Rule ''' || rule || ''' is broken', '; ' ORDER BY rule) FILTER (NOT success), '') AS validation_errors
FROM results GROUP BY 1)
SELECT table_name, total_rows, quality_score, validation_errors,
CASE WHEN quality_score >= 0.95e0 THEN total_rows ELSE 0 END AS valid_rows,
CASE WHEN quality_score >= 0.95e0 THEN 0 ELSE total_rows END AS invalid_rows FROM s""",
)
def _(shop):
    return Q.summarise(suite_results(shop)).withColumn("validation_errors", F.array_join("validation_errors", "; ")).select(
        "table_name", "total_rows", "quality_score", "validation_errors", "valid_rows", "invalid_rows"
    )


@query(
    "c9_row_validity", "users raw_users",
    """SELECT count(*) AS total_rows, count(*) FILTER (NOT coalesce(age BETWEEN 13 AND 100, false)
OR NOT coalesce(gender IN ('male', 'female', 'other'), false)
OR NOT coalesce(income_level IN ('low', 'medium', 'high', 'luxury'), false) OR user_id IS NULL) AS invalid_rows FROM raw_users""",
)
def _(shop):
    return Q.row_validity(shop.raw_users, Q.SUITES["users"])


@query(
    "c10_overall_score", VIEWS,
    f"""WITH {CATEGORIES_SQL}, {SUITE_SQL}, s AS (SELECT table_name, CAST(count(*) FILTER (success) AS DOUBLE) / count(*) AS score
FROM results GROUP BY 1), o AS (SELECT avg(score) AS overall FROM s)
SELECT round(overall, 6) AS overall_score, CASE WHEN overall >= 0.95e0 THEN 'EXCELLENT' WHEN overall >= 0.9e0 THEN 'GOOD'
WHEN overall >= 0.8e0 THEN 'FAIR' ELSE 'POOR' END AS assessment FROM o""",
)
def _(shop):
    return Q.overall(Q.summarise(suite_results(shop))).withColumn("overall_score", F.round("overall_score", 6))


@query(
    "c11_row_schema", "users raw_users products",
    "SELECT * FROM (" + " UNION ALL ".join(
        [
            _count("lower_in_set:gender", "NOT coalesce(lower(gender) IN ('male', 'female', 'other'), false)", "raw_users"),
            _count("lower_in_set:income_level", "NOT coalesce(lower(income_level) IN ('low', 'medium', 'high', 'luxury'), false)", "raw_users"),
            _count("lower_in_set:device_type", "NOT coalesce(lower(device_type) IN ('mobile', 'desktop', 'tablet'), false)", "raw_users"),
            _count("length:name", "NOT coalesce(length(name) BETWEEN 1 AND 200, false)", "products"),
            _count("length:description", "NOT coalesce(length(description) BETWEEN 10 AND 1000, false)", "products"),
        ]
    ) + ")",
)
def _(shop):
    return evaluated(shop.raw_users, *Q.ROW_RULES["users"]).unionByName(evaluated(shop.products, *Q.ROW_RULES["products"]))


@query(
    "c12_references", "users raw_interactions products",
    f"""WITH {CATEGORIES_SQL}
SELECT 'interaction user' AS reference, count(*) AS orphan_rows, count(DISTINCT user_id) AS orphan_values FROM raw_interactions
WHERE user_id NOT IN (SELECT user_id FROM users)
UNION ALL SELECT 'interaction product', count(*), count(DISTINCT product_id) FROM raw_interactions
WHERE product_id NOT IN (SELECT product_id FROM products)
UNION ALL SELECT 'parent category', count(*), count(DISTINCT parent_category) FROM categories WHERE level = 2
AND parent_category NOT IN (SELECT category_id FROM categories WHERE level = 1)""",
)
def _(shop):
    cats = categories(shop)
    parts = [
        Q.references(shop.raw_interactions, shop.users, "user_id", "user_id", "interaction user"),
        Q.references(shop.raw_interactions, shop.products, "product_id", "product_id", "interaction product"),
        Q.references(cats.where("level = 2"), cats.where("level = 1"), "parent_category", "category_id", "parent category"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "c13_strict_mode", VIEWS,
    f"""WITH {CATEGORIES_SQL}, {SUITE_SQL} SELECT table_name, CAST(count(*) FILTER (success) AS DOUBLE) / count(*) AS quality_score
FROM results GROUP BY 1""",
)
def _(shop):
    summary = Q.summarise(suite_results(shop)).select("table_name", "quality_score")
    return Q.require(summary, threshold=0.5)
