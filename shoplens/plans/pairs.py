"""Pair-feature and sample queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens.operators import pairfeatures as P
from shoplens.operators.recommend import personal
from shoplens.plans.ordering import md5_number
from shoplens.plans.registry import query

VIEWS = "users products interactions user_factors item_factors"
UBLOCK = """
us AS (SELECT user_id, count(*) AS n, CAST(sum(rating) AS DOUBLE) / count(rating) AS r, count(DISTINCT category) AS c,
  CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS p, count(*) FILTER (price > 500) / count(*) AS m
  FROM (SELECT i.user_id, i.rating, p.category, p.price FROM interactions i JOIN products p USING (product_id)) GROUP BY 1),
ublock AS (SELECT user_id, age, CASE income_level WHEN 'low' THEN 0.2e0 WHEN 'high' THEN 0.8e0 ELSE 0.5e0 END AS income_code,
  preference_category, coalesce(n, 0) AS total_interactions, coalesce(r, 3.5e0) AS avg_rating_given,
  coalesce(c / CAST((SELECT count(DISTINCT category) FROM products) AS DOUBLE), 0.5e0) AS category_diversity,
  coalesce(p, 500e0) AS avg_product_price, coalesce(m, 0.3e0) AS premium_ratio FROM users LEFT JOIN us USING (user_id))"""
IBLOCK = """
ist AS (SELECT product_id, count(*) AS n, avg(rating) AS r, count(rating) AS rn, avg(dwell_time) AS d, avg(scroll_depth) AS s,
  count(*) FILTER (interaction_type = 'purchase') AS bought, count(*) FILTER (interaction_type = 'view') AS viewed FROM interactions GROUP BY 1),
bs AS (SELECT brand, sum(coalesce(n, 0)) AS bn FROM products LEFT JOIN ist USING (product_id) GROUP BY 1),
iblock AS (SELECT product_id, price, rating AS item_rating, review_count, category,
  0.4e0 * coalesce(n, 0) + 0.3e0 * coalesce(r, 0) + 0.3e0 * coalesce(rn, 0) AS popularity_score, coalesce(0.5e0 * d + 0.5e0 * s, 0) AS engagement_score,
  CASE WHEN viewed > 0 THEN bought / viewed ELSE 0e0 END AS conversion_rate,
  CAST('0x' || substr(md5(category), 1, 7) AS BIGINT) % 100 / 100e0 AS category_code,
  CAST(bn AS DOUBLE) / (SELECT count(*) FROM interactions) AS brand_popularity
  FROM products JOIN bs USING (brand) LEFT JOIN ist USING (product_id))"""
PAIR = UBLOCK + "," + IBLOCK + """,
pairs AS (SELECT DISTINCT user_id, product_id FROM interactions),
feat AS (SELECT user_id, product_id, u.* EXCLUDE (user_id), i.* EXCLUDE (product_id),
  round(1e0 / (1e0 + abs(ln(1 + price) - ln(1 + avg_product_price))), 6) AS price_compatibility,
  round(1e0 - abs(avg_rating_given - item_rating) / 5e0, 6) AS rating_compatibility,
  CASE WHEN preference_category = category THEN 1e0 ELSE 0e0 END AS category_match,
  round(1e0 - abs(premium_ratio - CASE WHEN price > 500 THEN 1e0 ELSE 0e0 END), 6) AS premium_compatibility,
  round(CASE WHEN f.id IS NULL OR g.id IS NULL THEN 0e0 ELSE list_dot_product(f.vector, g.vector) END, 6) AS als_score,
  round(CASE WHEN f.id IS NULL OR g.id IS NULL THEN 0e0 ELSE list_dot_product(f.vector, g.vector) /
    (sqrt(list_dot_product(f.vector, f.vector)) * sqrt(list_dot_product(g.vector, g.vector)) + 1e-8) END, 6) AS embedding_cosine,
  round(CASE WHEN f.id IS NULL OR g.id IS NULL THEN 1e0 ELSE sqrt(list_dot_product(f.vector, f.vector)) END, 6) AS user_embedding_norm,
  round(CASE WHEN f.id IS NULL OR g.id IS NULL THEN 1e0 ELSE sqrt(list_dot_product(g.vector, g.vector)) END, 6) AS item_embedding_norm,
  CASE WHEN f.id IS NULL OR g.id IS NULL THEN 0e0 ELSE list_max(f.vector) END AS user_top_factor,
  CASE WHEN f.id IS NULL OR g.id IS NULL THEN 0e0 ELSE list_max(g.vector) END AS item_top_factor
  FROM pairs JOIN ublock u USING (user_id) JOIN iblock i USING (product_id)
  LEFT JOIN user_factors f ON f.id = user_id LEFT JOIN item_factors g ON g.id = product_id)"""
EMBED = ["als_score", "embedding_cosine", "user_embedding_norm", "item_embedding_norm", "user_top_factor", "item_top_factor"]
COMPAT = ["price_compatibility", "rating_compatibility", "category_match", "premium_compatibility"]
EXACT = {"category_match", "user_top_factor", "item_top_factor"}


def blocks(shop):
    return P.user_block(shop.users, shop.interactions, shop.products), P.item_block(shop.products, shop.interactions)


def pair_features(shop, pairs):
    users, items = blocks(shop)
    return P.pair_table(pairs, users, items, shop.user_factors, shop.item_factors, shop.now)


def seen_pairs(shop):
    return shop.interactions.select("user_id", "product_id").distinct()


def rounded(df, columns):
    return df.withColumns({c: F.round(c, 6) for c in columns if c not in EXACT})


@query("m1_user_block", "users products interactions", f"WITH {UBLOCK} SELECT * EXCLUDE (preference_category) FROM ublock")
def _(shop):
    return blocks(shop)[0].drop("preference_category")


@query("m2_item_block", "products interactions", f"WITH {IBLOCK} SELECT * EXCLUDE (category) FROM iblock")
def _(shop):
    return blocks(shop)[1].drop("category")


def _register(name: str, columns: list[str]) -> None:
    @query(name, VIEWS, f"WITH {PAIR} SELECT user_id, product_id, {', '.join(columns)} FROM feat")
    def _(shop):
        users, items = blocks(shop)
        joined = seen_pairs(shop).join(users, "user_id").join(items, "product_id")
        made = P.factor_features(joined, shop.user_factors, shop.item_factors) if columns == EMBED else P.compatibility(joined)
        return rounded(made, columns).select("user_id", "product_id", *columns)


_register("m3_price_compatibility", ["price_compatibility"])
_register("m4_rating_compatibility", ["rating_compatibility"])
_register("m5_category_match", ["category_match"])
_register("m6_premium_compatibility", ["premium_compatibility"])
_register("m7_embedding_features", EMBED)


@query(
    "m8_request_time", "users",
    """SELECT user_id, 0 AS hour_of_day, CAST(isodow(TIMESTAMP '2001-12-01') - 1 AS INT) AS day_of_week,
CAST(isodow(TIMESTAMP '2001-12-01') >= 6 AS DOUBLE) AS is_weekend, 0e0 AS is_evening, 0e0 AS is_morning FROM users""",
)
def _(shop):
    return P.request_time(shop.users.select("user_id"), shop.now)


@query(
    "m9_pair_features", VIEWS,
    f"""WITH {PAIR} SELECT * EXCLUDE (preference_category, category), 0 AS hour_of_day, 5 AS day_of_week, 1e0 AS is_weekend,
0e0 AS is_evening, 0e0 AS is_morning FROM feat""",
)
def _(shop):
    return rounded(pair_features(shop, seen_pairs(shop)).drop("preference_category", "category"), EMBED + COMPAT)


@query("m10_positive_samples", "interactions", "SELECT user_id, product_id, 1 AS label, coalesce(rating, 0) AS rating FROM interactions")
def _(shop):
    return P.positives(shop.interactions)


NEGATIVES = f"""
seen AS (SELECT DISTINCT user_id, product_id FROM interactions),
uix AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS k FROM (SELECT DISTINCT user_id FROM seen)),
iix AS (SELECT product_id, row_number() OVER (ORDER BY product_id) - 1 AS k FROM (SELECT DISTINCT product_id FROM seen)),
need AS (SELECT 2 * (SELECT count(*) FROM interactions) AS wanted, (SELECT count(*) FROM uix) * (SELECT count(*) FROM iix) AS pairs, (SELECT count(*) FROM seen) AS n),
draws AS (SELECT draw, {md5_number("draw || '|42'", 1)} % (SELECT count(*) FROM uix) AS ui, {md5_number("draw || '|42'", 17)} % (SELECT count(*) FROM iix) AS ii
  FROM (SELECT unnest(range(1, CAST(ceil((wanted + 10e0 * sqrt(wanted) + 100e0) * pairs / (pairs - n)) AS BIGINT) + 1)) AS draw FROM need)),
fresh AS (SELECT draw, uix.user_id, iix.product_id FROM draws JOIN uix ON uix.k = ui JOIN iix ON iix.k = ii
  ANTI JOIN seen x ON x.user_id = uix.user_id AND x.product_id = iix.product_id),
negatives AS (SELECT user_id, product_id FROM fresh QUALIFY row_number() OVER (ORDER BY draw) <= (SELECT wanted FROM need))"""


@query("m11_negative_samples", "interactions", f"WITH {NEGATIVES} SELECT user_id, product_id, 0 AS label, 0e0 AS rating FROM negatives")
def _(shop):
    return P.negatives(shop.interactions)


@query(
    "h1_training_union", "interactions",
    f"""WITH {NEGATIVES} SELECT user_id, product_id, 1 AS label, coalesce(rating, 0) AS rating FROM interactions
UNION ALL SELECT user_id, product_id, 0, 0e0 FROM negatives""",
)
def _(shop):
    return P.training_samples(shop.interactions)


@query(
    "m12_supervised", "users products interactions",
    """SELECT user_id, product_id, u.age AS user_age, p.price AS product_price, p.rating AS product_rating, quantity,
coalesce(dwell_time, 0) AS dwell_time, coalesce(i.rating, 0) AS target, CAST(coalesce(i.rating, 0) > 0 AS INT) AS interaction_success
FROM interactions i LEFT JOIN users u USING (user_id) LEFT JOIN products p USING (product_id)""",
)
def _(shop):
    wanted = ["user_id", "product_id", "user_age", "product_price", "product_rating", "quantity", "dwell_time", "not_there"]
    return P.supervised(shop.interactions, shop.users, shop.products, wanted)


TOP20 = """SELECT u.id AS user_id, i.id AS product_id FROM user_factors u CROSS JOIN item_factors i
QUALIFY row_number() OVER (PARTITION BY u.id ORDER BY round(list_dot_product(u.vector, i.vector), 6) DESC, i.id) <= 20"""


@query(
    "m13_inference", VIEWS,
    f"""WITH c AS ({TOP20}) SELECT user_id, product_id, u.age AS user_age, u.income_level AS user_income_level, p.price AS product_price,
p.category AS product_category, 1 AS quantity, 0 AS dwell_time, 0 AS scroll_depth, 1 AS session_length, 0 AS hour_of_day, 5 AS day_of_week,
true AS is_weekend, false AS is_business_hours FROM c JOIN users u USING (user_id) JOIN products p USING (product_id)""",
)
def _(shop):
    candidates = personal(shop.user_factors, shop.item_factors, 20)
    users, products = shop.users.select("user_id", "age", "income_level"), shop.products.select("product_id", "price", "category")
    return P.inference_table(candidates, users, products, shop.now)
