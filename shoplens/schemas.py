"""Declared schemas, enumerations and threshold tables."""

from __future__ import annotations

from pyspark.sql import types as T

LONG, INT, DBL, STR, BOOL = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType()
TS = T.TimestampType()


def struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


# --- the supplied tables; their wall-clock times are read as UTC instants, so that time filters reach the scan -------------------------------------------------------------------------------
SUPPLIED = {
    "region": struct(r_regionkey=INT, r_name=STR),
    "nation": struct(n_nationkey=INT, n_name=STR, n_regionkey=INT),
    "customer": struct(c_custkey=LONG, c_name=STR, c_nationkey=INT, c_acctbal=DBL, c_mktsegment=STR),
    "supplier": struct(s_suppkey=LONG, s_name=STR, s_nationkey=INT, s_acctbal=DBL),
    "part": struct(p_partkey=LONG, p_name=STR, p_brand=STR, p_type=STR, p_size=INT, p_retailprice=DBL),
    "orders": struct(
        o_orderkey=LONG, o_custkey=LONG, o_orderstatus=STR, o_totalprice=DBL, o_orderdate=TS, o_orderpriority=STR
    ),
    "lineitem": struct(
        l_orderkey=LONG, l_partkey=LONG, l_suppkey=LONG, l_linenumber=INT, l_quantity=DBL, l_extendedprice=DBL,
        l_discount=DBL, l_tax=DBL, l_returnflag=STR, l_linestatus=STR, l_shipdate=TS,
    ),
    "events": struct(event_id=LONG, ts=TS, user_id=LONG, event_type=STR, value=DBL, props=STR),
    "documents": struct(doc_id=LONG, text=STR, lang=STR, source=STR, n_chars=LONG),
    "embeddings": struct(vec_id=LONG, embedding=T.ArrayType(T.FloatType()), label=INT),
    "labels": struct(doc_id=LONG, quality=INT, toxic=INT),
}

# --- the shop's own tables -----------------------------------------------------------------------------
USERS = struct(
    user_id=LONG, age=INT, gender=STR, location=STR, income_level=STR, preference_category=STR, device_type=STR,
    language_preference=STR, timezone=STR, email=STR, created_at=TS, last_active=TS,
)
PRODUCTS = struct(
    product_id=LONG, name=STR, description=STR, category=STR, subcategory=STR, brand=STR, price=DBL,
    discount_percentage=DBL, stock_quantity=INT, rating=DBL, review_count=INT, shipping_cost=DBL, weight=DBL,
    dimensions=STR, color=STR, size=STR, availability_status=STR, image_url=STR, tags=T.ArrayType(STR), created_at=TS,
)
INTERACTIONS = struct(
    interaction_id=LONG, user_id=LONG, product_id=LONG, interaction_type=STR, timestamp=TS, rating=DBL,
    review_text=STR, session_id=STR, quantity=INT, total_amount=DBL, payment_method=STR, dwell_time=INT,
    scroll_depth=INT,
)
CATEGORIES = struct(category_id=INT, name=STR, parent_category=INT, description=STR, level=INT)
ORDERS = struct(
    order_id=LONG, user_id=LONG, order_date=TS, total_amount=DBL, status=STR, payment_status=STR,
    shipping_address=STR, shipping_cost=DBL,
)
PRODUCT_CATEGORIES = struct(product_id=LONG, category_id=INT, is_primary=BOOL)
CART_ITEMS = struct(cart_id=LONG, user_id=LONG, product_id=LONG, quantity=INT, added_at=TS)
SEARCH_QUERIES = struct(
    query_id=LONG, user_id=LONG, search_query=STR, timestamp=TS, results_count=INT, clicked_product_id=LONG
)
USER_PREFERENCES = struct(user_id=LONG, category_id=INT, preference_type=STR, strength=DBL, created_at=TS)
CLICKSTREAM = struct(
    event_id=STR, user_id=LONG, product_id=LONG, event_type=STR, timestamp=TS, session_id=STR, page_url=STR,
    referrer_url=STR, user_agent=STR, ip_address=STR, dwell_time=DBL, scroll_depth=DBL, device_type=STR, location=STR,
)
METRICS = struct(
    ts=TS, metric_name=STR, metric_value=DBL, user_id=LONG, model_version=STR, metadata=T.MapType(STR, STR)
)
TABLES = {
    "users": USERS, "products": PRODUCTS, "interactions": INTERACTIONS, "categories": CATEGORIES, "orders": ORDERS,
    "product_categories": PRODUCT_CATEGORIES, "cart_items": CART_ITEMS, "search_queries": SEARCH_QUERIES,
    "user_preferences": USER_PREFERENCES,
}

# --- fixed values: enumerations, weights and thresholds that results depend on ------------------------
GENDERS = ["male", "female", "other"]
INCOME_LEVELS = ["low", "medium", "high", "luxury"]
DEVICES = ["mobile", "desktop", "tablet"]
INTERACTION_TYPES = ["view", "click", "add_to_cart", "purchase", "rating", "review"]
AVAILABILITY = ["in_stock", "out_of_stock", "discontinued"]
FUNNEL = ["view", "click", "add_to_cart", "purchase"]
FUNNEL_WEIGHTS = {"view": 0.1, "click": 0.3, "add_to_cart": 0.5, "purchase": 1.0}
BASKET_TYPES = ["purchase", "add_to_cart"]
INCOME_CODE = {"low": 0.2, "medium": 0.5, "high": 0.8}
AFFORDABLE_PRICE = {"low": 100.0, "medium": 500.0, "high": 1000.0}
QUALITY_THRESHOLD = 0.95
RETENTION_DAYS = {"events": 7, "features": 30}
USER_TTL_SECONDS, PRODUCT_TTL_SECONDS = 3600, 7200
STATE_TTL_DAYS = 30
# metric, severity, threshold; a value strictly above the threshold raises the alert
ALERT_RULES = [
    ("latency_p95", "critical", 300.0),
    ("latency_p95", "warning", 200.0),
    ("error_rate", "critical", 5.0),
    ("error_rate", "warning", 2.0),
    ("ctr_drop", "critical", 20.0),
    ("ctr_drop", "warning", 10.0),
]
COOLDOWN_SECONDS, ROLLBACKS_PER_HOUR = 600, 3
