"""Vector similarity and nearest-neighbour queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens.operators import baskets as B
from shoplens.operators import similarity as S
from shoplens.operators.joins import enrich
from shoplens.plans.baskets import SHARED
from shoplens.plans.registry import query
from shoplens.sources import sinks

COSINES = """
cosines AS (SELECT a.id AS item_id, b.id AS other_id, round(list_cosine_similarity(a.vector, b.vector), 6) AS score
            FROM item_factors a JOIN item_factors b ON a.id <> b.id)"""
HYBRID = SHARED + "," + COSINES + """,
known AS (SELECT b.* FROM buyers b WHERE item_id IN (SELECT id FROM item_factors) AND other_id IN (SELECT id FROM item_factors)),
span AS (SELECT min(score) AS low, max(score) AS high FROM cosines),
top_shared AS (SELECT max(score) AS high FROM known),
hybrids AS (SELECT c.item_id, c.other_id, round(0.7e0 * ((c.score - low) / (span.high - low)) + 0.3e0 * (coalesce(k.score, 0) / top_shared.high), 6) AS score
            FROM cosines c LEFT JOIN known k USING (item_id, other_id) CROSS JOIN span CROSS JOIN top_shared)"""


def _top(source: str, k: int, score: str = "score") -> str:
    return f"""SELECT item_id, other_id, {score} AS score, row_number() OVER (PARTITION BY item_id ORDER BY {score} DESC, other_id) AS rank
FROM {source} QUALIFY rank <= {k}"""


INDEX = HYBRID + f""",
idx AS (SELECT 'als' AS kind, * FROM ({_top('cosines', 50)}) WHERE score > 0
  UNION ALL SELECT 'copurchase', * FROM ({_top('buyers', 50, 'round(score, 6)')}) WHERE score > 0
  UNION ALL SELECT 'hybrid', * FROM ({_top('hybrids', 50)}) WHERE score > 0)"""


@query(
    "k1_cosine_rows", "item_factors",
    f"""WITH {COSINES} SELECT item_id AS id, count(*) AS pairs, round(sum(score), 6) AS total, min(score) AS low, max(score) AS high,
count(*) FILTER (score <> 0) AS nonzero FROM cosines GROUP BY 1""",
)
def _(shop):
    return S.cosine_rows(shop.item_factors).withColumn("total", F.round("total", 6))


@query("k1_most_similar", "item_factors", f"WITH {COSINES} {_top('cosines', 10)}")
def _(shop):
    return S.most_similar(shop.item_factors, 10)


def shared(shop):
    return B.shared_buyers(shop.interactions)


@query(
    "k2_normalised_scores", "interactions",
    f"""WITH {SHARED}, r AS (SELECT count(*) AS c, min(score) AS low, max(score) AS high FROM buyers), n AS (SELECT count(*) AS n FROM freq)
SELECT item_id, other_id, (score - lo) / (high - lo) AS score FROM buyers, (SELECT CASE WHEN c = n * (n - 1) THEN low ELSE 0 END AS lo, high FROM r, n)""",
)
def _(shop):
    n = B.frequencies(shop.interactions.where(F.col("interaction_type") != "view").select(F.col("product_id").alias("item")))
    return S.normalised_pairs(shared(shop), n.agg(F.count(F.lit(1)).alias("n")).scalar())


@query("k3_hybrid_scores", "interactions item_factors", f"WITH {HYBRID} {_top('hybrids', 10)}")
def _(shop):
    return S.hybrid(shop.item_factors, shared(shop), 10)


def index(shop):
    return S.build_index(shop.item_factors, shared(shop))


@query("k4_similarity_index", "interactions item_factors", f"WITH {INDEX} SELECT kind, item_id, other_id, score, rank FROM idx")
def _(shop):
    return index(shop)


@query(
    "k5_similar_items", "interactions item_factors products",
    f"""WITH {INDEX} SELECT item_id, other_id, score, rank, name, category, brand, price, rating AS product_rating,
substr(description, 1, 100) || '...' AS summary FROM idx LEFT JOIN products ON product_id = other_id
WHERE kind = 'als' AND rank <= 5 AND item_id IN (SELECT product_id FROM products WHERE category = 'PROMO')""",
)
def _(shop):
    wanted = shop.products.where("category = 'PROMO'").select(F.col("product_id").alias("item_id"))
    found = S.similar_to(index(shop), wanted, "als", 5)
    return enrich(found.drop("kind"), shop.products, "other_id")


@query(
    "k6_index_statistics", "interactions item_factors",
    f"""WITH {INDEX} SELECT kind, count(*) AS items_covered, avg(n) AS mean_length FROM (SELECT kind, item_id, count(*) AS n FROM idx GROUP BY 1, 2) GROUP BY 1""",
)
def _(shop):
    return S.index_statistics(index(shop))


@query(
    "k6_cosine_statistics", "item_factors",
    f"""WITH {COSINES}, n AS (SELECT count(*) AS n FROM item_factors) SELECT max(n) AS items, round(sum(score) / (max(n) * max(n)), 6) AS mean_score,
greatest(max(score), 0) AS max_score, count(*) FILTER (score <> 0) AS non_zero FROM cosines, n""",
)
def _(shop):
    totals = S.cosine_rows(shop.item_factors).agg(
        F.count(F.lit(1)).alias("items"), F.sum("total").alias("t"), F.max("high").alias("h"), F.sum("nonzero").alias("non_zero")
    )
    return totals.select(
        "items", F.round(F.col("t") / (F.col("items") * F.col("items")), 6).alias("mean_score"),
        F.greatest(F.col("h"), F.lit(0.0)).alias("max_score"), "non_zero",
    )


@query(
    "k7_exact_neighbours", "user_factors item_factors",
    """WITH s AS (SELECT u.id, i.id AS other, round(list_cosine_similarity(u.vector, i.vector), 6) AS score FROM user_factors u, item_factors i)
SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rank, round(1 - score, 6) AS distance FROM s QUALIFY rank <= 10""",
)
def _(shop):
    return S.nearest(shop.user_factors, shop.item_factors, 10)


@query(
    "k8_inverted_lists", "user_factors item_factors",
    "SELECT id, least(10, (SELECT count(*) FROM item_factors)) AS found, least(10, (SELECT count(*) FROM item_factors)) AS last_rank, true AS cosines FROM user_factors",
)
def _(shop):
    """Per query: distinct neighbours found, the last rank, and whether all scores are cosines."""
    rows = S.InvertedLists(shop.item_factors).search(shop.user_factors, 10)
    return rows.groupBy("id").agg(
        F.countDistinct("other").alias("found"), F.max("rank").cast("long").alias("last_rank"), F.min(F.col("score").between(-1.0, 1.0)).alias("cosines")
    )


@query("k9_item_neighbours", "item_factors", f"WITH {COSINES} {_top('cosines', 20)}")
def _(shop):
    return S.most_similar(shop.item_factors, 20)


@query(
    "k10_items_for_user", "user_factors item_factors interactions",
    """WITH s AS (SELECT u.id, i.id AS other, round(list_cosine_similarity(u.vector, i.vector), 6) AS score FROM user_factors u, item_factors i
WHERE NOT EXISTS (SELECT 1 FROM interactions x WHERE x.user_id = u.id AND x.product_id = i.id))
SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rank, round(1 - score, 6) AS distance FROM s QUALIFY rank <= 10""",
)
def _(shop):
    seen = shop.interactions.select(F.col("user_id").alias("id"), F.col("product_id").alias("other"))
    return S.nearest(shop.user_factors, shop.item_factors, 10, skip=seen)


@query(
    "k11_unit_vectors", "item_factors",
    """SELECT id, unnest(range(64)) AS pos, round(unnest(vector) / sqrt(list_dot_product(vector, vector)), 6) AS value FROM item_factors""",
)
def _(shop):
    return S.unit_vectors(shop.item_factors).select("id", F.posexplode("vector").alias("pos", "value")).select(
        "id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value")
    )


@query("k12_recall", "user_factors item_factors", "SELECT count(*) * least(10, (SELECT count(*) FROM item_factors)) AS wanted, true AS nine_of_ten FROM user_factors")
def _(shop):
    exact = S.nearest(shop.user_factors, shop.item_factors, 10)
    found = S.recall(exact, S.InvertedLists(shop.item_factors).search(shop.user_factors, 10))
    return found.select("wanted", (F.col("recall") >= 0.9).alias("nine_of_ten"))


@query("a12_similarity_artefact", "item_factors", f"WITH {COSINES} SELECT item_id, other_id, score FROM ({_top('cosines', 10)})")
def _(shop):
    folder = sinks.run_folder(shop.spark, "similarity")
    sinks.save_similarity(S.most_similar(shop.item_factors, 10).select("item_id", "other_id", "score"), folder)
    return sinks.load_similarity(shop.spark, folder)
