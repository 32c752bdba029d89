"""Registration of named queries with their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shoplens.sources.tables import Shop

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The canonical views of shoplens.sources.tables, written independently in SQL.
VIEWS = {
    "users": """
users AS (
  SELECT c_custkey AS user_id, CAST(13 + c_custkey % 80 AS INTEGER) AS age,
    CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'other' END AS gender,
    n_name AS location,
    CASE WHEN c_acctbal < 0 THEN 'low' WHEN c_acctbal < 3000 THEN 'medium' WHEN c_acctbal < 7000 THEN 'high'
         ELSE 'luxury' END AS income_level,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'ECONOMY' WHEN 'AUTOMOBILE' THEN 'STANDARD' WHEN 'MACHINERY' THEN 'LARGE'
         WHEN 'HOUSEHOLD' THEN 'MEDIUM' WHEN 'FURNITURE' THEN 'SMALL' END AS preference_category,
    CASE c_custkey % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' ELSE 'tablet' END AS device_type,
    lower(replace(c_name, '#', '.')) || '@shop.example' AS email,
    created_at, last_active
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS created_at, max(o_orderdate) AS last_active FROM orders GROUP BY 1) s
    ON o_custkey = c_custkey)""",
    "products": """
products AS (
  SELECT p_partkey AS product_id, p_name AS name, p_name || ' ' || p_brand || ' ' || p_type AS description,
    p_type AS category, p_brand AS brand, p_size AS size, p_retailprice AS price,
    CAST(p_partkey % 40 AS DOUBLE) AS discount_percentage, CAST(p_partkey % 97 AS INTEGER) AS stock_quantity,
    1e0 + CAST(p_partkey % 41 AS DOUBLE) / 10e0 AS rating, CAST(p_partkey % 500 AS INTEGER) AS review_count
  FROM part)""",
    "interactions": """
interactions AS (
  SELECT o_custkey AS user_id, l_partkey AS product_id, l_orderkey AS session_id, l_linenumber AS line,
    CASE l_returnflag WHEN 'N' THEN 'purchase' WHEN 'A' THEN 'add_to_cart' WHEN 'R' THEN 'view' END AS interaction_type,
    l_shipdate AS ts, CASE WHEN l_returnflag <> 'R' THEN CAST(1 + l_linenumber % 5 AS DOUBLE) END AS rating,
    CAST(l_quantity AS INTEGER) AS quantity, l_extendedprice AS total_amount,
    CASE WHEN l_returnflag <> 'A' THEN CAST(l_suppkey % 300 AS INTEGER) END AS dwell_time,
    CAST((l_partkey + l_suppkey) % 101 AS INTEGER) AS scroll_depth
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "clickstream": """
clickstream AS (
  SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id,
    CASE event_type WHEN 'signup' THEN 'add_to_cart' ELSE event_type END AS event_type, ts,
    CASE WHEN event_id % 10 <> 3 THEN value END AS dwell_time,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS scroll_depth,
    CASE event_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' ELSE 'tablet' END AS device_type,
    'NATION_' || (user_id % 25) AS location
  FROM events)""",
    "metrics": """
metrics AS (
  SELECT event_id, ts, CASE WHEN event_type = 'error' THEN 'error' ELSE 'latency_ms' END AS metric_name,
    CASE WHEN event_type = 'error' THEN 1e0 ELSE value END AS metric_value, user_id, 'v' || (user_id % 3) AS model_version
  FROM events)""",
    "user_factors": """
user_factors AS (SELECT vec_id // 5 AS id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings WHERE vec_id % 5 = 0)""",
    "item_factors": """
item_factors AS (SELECT vec_id - vec_id // 5 - 1 AS id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings WHERE vec_id % 5 <> 0)""",
    "raw_users": """
raw_users AS (
  SELECT user_id, CASE WHEN user_id % 7 <> 0 THEN age END AS age, CASE WHEN user_id % 5 <> 0 THEN gender END AS gender,
    CASE WHEN user_id % 9 <> 0 THEN '  ' || replace(lower(location), '_', ' ') || ' ' END AS location,
    CASE WHEN user_id % 4 <> 0 THEN income_level END AS income_level, ' ' || preference_category AS preference_category,
    device_type, ' ' || upper(email) || '  ' AS email,
    CASE WHEN user_id % 8 = 0 THEN 'not a date' ELSE strftime(created_at, '%Y-%m-%d %H:%M:%S') END AS created_at,
    strftime(last_active, '%Y-%m-%d %H:%M:%S') AS last_active
  FROM users)""",
    "raw_products": """
raw_products AS (
  SELECT product_id, '  ' || name || ' ' AS name, category, brand,
    CASE WHEN product_id % 17 = 0 THEN NULL WHEN product_id % 13 = 0 THEN CAST(price AS VARCHAR) || 'x'
         WHEN product_id % 19 = 0 THEN '-1' ELSE CAST(price AS VARCHAR) END AS price,
    discount_percentage, CASE WHEN product_id % 6 <> 0 THEN CAST(product_id % 56 AS DOUBLE) / 10e0 END AS rating,
    CASE WHEN product_id % 10 <> 0 THEN review_count END AS review_count,
    CASE WHEN product_id % 14 <> 0 THEN stock_quantity END AS stock_quantity
  FROM products)""",
    "raw_interactions": """
raw_interactions AS (
  SELECT * REPLACE (CASE WHEN session_id % 13 = 0 THEN -user_id ELSE user_id END AS user_id,
    CASE WHEN (session_id + line) % 11 = 0 THEN product_id + 1000000000 ELSE product_id END AS product_id,
    CASE WHEN product_id % 5 <> 0 THEN rating END AS rating) FROM interactions)""",
}
NEEDS = {"raw_users": ["users"], "raw_products": ["products"], "raw_interactions": ["interactions"]}


def _with(views: str, sql: str) -> str:
    wanted: list[str] = []
    for view in views.split():
        for name in [*NEEDS.get(view, []), view]:
            if name not in wanted:
                wanted.append(name)
    parts = [VIEWS[name].strip() for name in wanted]
    sql = sql.strip()
    lowered = sql[:5].upper()
    if not parts:
        return sql
    if lowered == "WITH ":
        rest = sql[5:]
        recursive = rest[:10].upper() == "RECURSIVE "
        return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + ",\n" + (rest[10:] if recursive else rest)
    return "WITH " + ",\n".join(parts) + "\n" + sql


def query(name: str, views: str = "", sql: str | None = None):
    """Register ``fn(shop) -> DataFrame`` under a name; ``sql`` may use the listed canonical views."""

    def register(fn: Callable[[Shop], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Shop(spark, folder))
        if sql is not None:
            ORACLES[name] = _with(views, sql)
        return fn

    return register
