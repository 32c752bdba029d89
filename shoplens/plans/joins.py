"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens.functions.blocks import best_matches, pair_counts
from shoplens.functions.scalars import exact_mean, exact_sum
from shoplens.operators import aggregates as A
from shoplens.operators import baskets as B
from shoplens.operators import joins as J
from shoplens.operators.cleaning import rows_of
from shoplens.plans.baskets import LATEST, RULES, TOP_PARTNERS_SQL, latest_sessions, top_partners, user_rules
from shoplens.plans.quality import CATEGORIES_SQL, categories
from shoplens.plans.registry import query

USER_STATS = """SELECT user_id, count(*) AS total_interactions, CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS total_spent
FROM interactions WHERE interaction_type = 'purchase' GROUP BY 1"""


@query(
    "d1_user_stats", "users interactions",
    f"""WITH s AS ({USER_STATS}) SELECT user_id, location, coalesce(total_interactions, 0) AS total_interactions,
coalesce(total_spent, 0) AS total_spent FROM users LEFT JOIN s USING (user_id)""",
)
def _(shop):
    stats = rows_of(shop.interactions, "interaction_type", "purchase").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_interactions"), exact_sum("total_amount").alias("total_spent")
    )
    return J.attach_stats(shop.users.select("user_id", "location"), stats, "user_id", ["total_interactions", "total_spent"])


@query(
    "d2_facts_with_dimensions", "users products interactions",
    """SELECT user_id, product_id, line, total_amount, u.income_level AS user_income_level, p.category AS product_category,
p.price AS product_price FROM interactions LEFT JOIN users u USING (user_id) LEFT JOIN products p USING (product_id)""",
)
def _(shop):
    facts = shop.interactions.select("user_id", "product_id", "line", "total_amount")
    return J.with_dimensions(facts, shop.users, shop.products, ["income_level"], ["category", "price"])


@query(
    "d3_prefixed_join", "users products interactions",
    """SELECT user_id, product_id, i.rating AS interaction_rating, p.rating AS product_rating, u.age AS user_age
FROM interactions i LEFT JOIN users u USING (user_id) LEFT JOIN products p USING (product_id)""",
)
def _(shop):
    facts = shop.interactions.select("user_id", "product_id", F.col("rating").alias("interaction_rating"))
    return J.with_dimensions(facts, shop.users, shop.products, ["age"], ["rating"])


SESSION = """SELECT session_id, count(*) AS session_length, count(DISTINCT product_id) AS unique_products,
CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS session_value FROM interactions GROUP BY 1"""


@query(
    "d4_session_join_back", "interactions",
    f"""WITH s AS ({SESSION}) SELECT user_id, product_id, session_id, session_length, unique_products, session_value
FROM interactions JOIN s USING (session_id)""",
)
def _(shop):
    facts = shop.interactions.select("user_id", "product_id", "session_id")
    return J.attach_group(facts, A.session_profile(shop.interactions), "session_id")


@query(
    "d5_history_by_category", "products interactions",
    """SELECT user_id, category, count(*) AS n, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) / count(price) AS avg_price
FROM interactions JOIN products USING (product_id) GROUP BY 1, 2""",
)
def _(shop):
    joined = shop.interactions.select("user_id", "product_id").join(shop.products.select("product_id", "category", "price"), "product_id")
    return joined.groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("n"), exact_mean("price").alias("avg_price"))


@query(
    "d6_enriched_lists", "products interactions",
    f"""WITH top AS ({TOP_PARTNERS_SQL}) SELECT item_id, other_id, score, rank, name, category, brand, price,
rating AS product_rating, substr(description, 1, 100) || '...' AS summary FROM top LEFT JOIN products ON product_id = other_id""",
)
def _(shop):
    return J.enrich(top_partners(shop), shop.products, "other_id")


MAPS = """
uix AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS user_idx FROM users),
iix AS (SELECT product_id, row_number() OVER (ORDER BY product_id) - 1 AS item_idx FROM products)"""


def known_maps(shop):
    """Indices of the users and products that the shop knows."""
    return J.dense_index(shop.users, "user_id", "user_idx"), J.dense_index(shop.products, "product_id", "item_idx")


@query(
    "d7_index_join", "users products raw_interactions",
    f"WITH {MAPS} SELECT user_idx, item_idx, rating FROM raw_interactions JOIN uix USING (user_id) JOIN iix USING (product_id)",
)
def _(shop):
    return J.to_indices(shop.raw_interactions.select("user_id", "product_id", "rating"), *known_maps(shop)).select("user_idx", "item_idx", "rating")


@query(
    "d7_unmatched", "users products raw_interactions",
    f"""WITH {MAPS} SELECT count(*) AS interactions, count(*) FILTER (user_idx IS NULL OR item_idx IS NULL) AS dropped
FROM raw_interactions LEFT JOIN uix USING (user_id) LEFT JOIN iix USING (product_id)""",
)
def _(shop):
    return J.unmatched(shop.raw_interactions, *known_maps(shop))


@query(
    "d8_exclude_seen", "interactions",
    f"""WITH {RULES}{LATEST},
top AS (SELECT item_id, other_id, row_number() OVER (PARTITION BY item_id ORDER BY round(jaccard, 6) DESC, other_id) AS rank FROM rules
        QUALIFY rank <= 10),
c AS (SELECT DISTINCT basket AS user_id, other_id AS product_id FROM wanted JOIN top ON item_id = item)
SELECT user_id, product_id FROM c WHERE NOT EXISTS
  (SELECT 1 FROM interactions i WHERE i.user_id = c.user_id AND i.product_id = c.product_id)""",
)
def _(shop):
    """Companions of the items in each user's latest session that the user has never touched."""
    candidates = latest_sessions(shop).join(top_partners(shop), F.col("item") == F.col("item_id")).select(
        F.col("basket").alias("user_id"), F.col("other_id").alias("product_id")
    ).distinct()
    return J.exclude_seen(candidates, shop.interactions, ["user_id", "product_id"])


@query(
    "d9_semi_join", "products interactions",
    """SELECT user_id, product_id, quantity FROM interactions WHERE product_id IN (SELECT product_id FROM products WHERE price > 950)""",
)
def _(shop):
    dear = shop.products.where("price > 950")
    return J.restrict(shop.interactions.select("user_id", "product_id", "quantity"), dear, "product_id")


@query(
    "d10_pairs_in_session", "interactions",
    """WITH s AS (SELECT DISTINCT session_id, product_id FROM interactions)
SELECT x.product_id AS a, y.product_id AS b, count(*) AS together FROM s x JOIN s y USING (session_id)
WHERE x.product_id < y.product_id GROUP BY 1, 2""",
)
def _(shop):
    return pair_counts(shop.interactions.select("session_id", "product_id").distinct(), "session_id", "product_id")


@query(
    "d11_all_pairs_scored", "user_factors item_factors",
    """SELECT u.id AS user_id, i.id AS item_id, round(list_dot_product(u.vector, i.vector), 6) AS score,
row_number() OVER (PARTITION BY u.id ORDER BY round(list_dot_product(u.vector, i.vector), 6) DESC, i.id) AS rank
FROM user_factors u CROSS JOIN item_factors i QUALIFY rank <= 20""",
)
def _(shop):
    found = best_matches(shop.user_factors, shop.item_factors, 20)
    return found.select(F.col("id").alias("user_id"), F.col("other").alias("item_id"), "score", "rank")


@query(
    "d12_aligned_lists", "interactions",
    f"""WITH {RULES},
l AS (SELECT item_id, other_id, row_number() OVER (PARTITION BY item_id ORDER BY round(jaccard, 6) DESC, other_id) AS rank FROM rules QUALIFY rank <= 10),
r AS (SELECT item_id, other_id, row_number() OVER (PARTITION BY item_id ORDER BY together DESC, other_id) AS rank FROM rules QUALIFY rank <= 10)
SELECT item_id, other_id, l.rank AS rank_left, r.rank AS rank_right, r.rank - l.rank AS rank_change
FROM l FULL JOIN r USING (item_id, other_id)""",
)
def _(shop):
    rules = user_rules(shop)
    by_jaccard = B.top_partners(rules.withColumn("score", F.round("jaccard", 6)))
    by_count = B.top_partners(rules, score="together")
    return J.align(by_jaccard, by_count, ["item_id", "other_id"], {"rank": "rank"})


@query(
    "d13_category_parents",
    sql=f"""WITH {CATEGORIES_SQL} SELECT c.category_id, c.name, p.category_id AS parent_id, p.name AS parent_name
FROM categories c LEFT JOIN categories p ON c.parent_category = p.category_id WHERE c.level = 2""",
)
def _(shop):
    return J.with_parent(categories(shop))
