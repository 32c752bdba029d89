"""Co-purchase and market-basket queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.operators import baskets as B
from shoplens.plans.registry import query

BASKETS = """
kept AS (SELECT DISTINCT user_id AS basket, product_id AS item FROM interactions
         WHERE interaction_type IN ('purchase', 'add_to_cart')),
sizes AS (SELECT basket, count(*) AS n FROM kept GROUP BY 1 HAVING count(*) > 1),
baskets AS (SELECT basket, item FROM kept JOIN sizes USING (basket)),
freq AS (SELECT item, count(*) AS frequency FROM baskets GROUP BY 1)"""
PAIRS = BASKETS + """,
pairs AS (SELECT x.item AS a, y.item AS b, count(*) AS together FROM baskets x JOIN baskets y USING (basket)
          WHERE x.item < y.item GROUP BY 1, 2)"""
RULES = PAIRS + """,
directed AS (SELECT a AS item_id, b AS other_id, together FROM pairs WHERE together >= 2
             UNION ALL SELECT b, a, together FROM pairs WHERE together >= 2),
total AS (SELECT count(DISTINCT basket) AS n FROM baskets),
rules AS (SELECT item_id, other_id, together,
  CAST(together AS DOUBLE) / (f.frequency + g.frequency - together) AS jaccard,
  (CAST(together AS DOUBLE) / n) / ((CAST(f.frequency AS DOUBLE) / n) * (CAST(g.frequency AS DOUBLE) / n)) AS lift,
  CAST(together AS DOUBLE) / f.frequency AS confidence
  FROM directed JOIN freq f ON f.item = item_id JOIN freq g ON g.item = other_id CROSS JOIN total)"""


def user_baskets(shop) -> DataFrame:
    return B.extract(shop.interactions)


def user_rules(shop) -> DataFrame:
    baskets = user_baskets(shop)
    return B.associations(baskets, B.cooccurrence(baskets))


@query("j1_baskets", "interactions", f"WITH {BASKETS} SELECT basket, item FROM baskets")
def _(shop):
    return user_baskets(shop).select("basket", "item")


@query("j2_item_frequency", "interactions", f"WITH {BASKETS} SELECT item, frequency FROM freq")
def _(shop):
    return B.frequencies(user_baskets(shop))


@query(
    "j3_cooccurrence", "interactions",
    f"WITH {PAIRS} SELECT a AS item_id, b AS other_id, together FROM pairs UNION ALL SELECT b, a, together FROM pairs",
)
def _(shop):
    return B.mirrored(B.cooccurrence(user_baskets(shop)))


@query("j4_jaccard", "interactions", f"WITH {RULES} SELECT item_id, other_id, jaccard AS score FROM rules")
def _(shop):
    baskets = user_baskets(shop)
    return B.jaccard(baskets, B.cooccurrence(baskets))


@query("j5_lift", "interactions", f"WITH {RULES} SELECT item_id, other_id, round(lift, 6) AS lift FROM rules")
def _(shop):
    return user_rules(shop).select("item_id", "other_id", F.round("lift", 6).alias("lift"))


@query("j6_confidence", "interactions", f"WITH {RULES} SELECT item_id, other_id, confidence FROM rules")
def _(shop):
    return user_rules(shop).select("item_id", "other_id", "confidence")


@query(
    "j7_frequent_itemsets", "interactions",
    f"""WITH {BASKETS},
floor_ AS (SELECT greatest(CAST(floor(0.01e0 * count(DISTINCT basket)) AS BIGINT), 1) AS k FROM baskets),
ones AS (SELECT item, frequency FROM freq, floor_ WHERE frequency >= k),
slim AS (SELECT basket, item FROM baskets JOIN ones USING (item)),
twos AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM slim x JOIN slim y USING (basket) WHERE x.item < y.item
         GROUP BY 1, 2 HAVING count(*) >= (SELECT k FROM floor_)),
threes AS (SELECT t.a, t.b, z.item AS c, count(*) AS n FROM twos t JOIN slim x ON x.item = t.a
           JOIN slim y ON y.basket = x.basket AND y.item = t.b JOIN slim z ON z.basket = x.basket AND z.item > t.b
           GROUP BY 1, 2, 3 HAVING count(*) >= (SELECT k FROM floor_))
SELECT CAST(item AS VARCHAR) AS items, frequency AS freq FROM ones
UNION ALL SELECT a || ',' || b, n FROM twos UNION ALL SELECT a || ',' || b || ',' || c, n FROM threes""",
)
def _(shop):
    found = B.frequent_itemsets(user_baskets(shop), 0.01, 3)
    return found.select(F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), "freq")


@query(
    "j8_basket_analysis", "interactions",
    f"""WITH {RULES}, top AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY together DESC, other_id) AS rank FROM rules
  QUALIFY rank <= 10)
SELECT f.item AS item_id, f.frequency, CAST(f.frequency AS DOUBLE) / n AS support, other_id, together, jaccard,
  round(lift, 6) AS lift, confidence, rank
FROM freq f CROSS JOIN total LEFT JOIN top ON top.item_id = f.item""",
)
def _(shop):
    baskets = user_baskets(shop)
    rules = B.associations(baskets, B.cooccurrence(baskets))
    return B.profile(baskets, rules).withColumn("lift", F.round("lift", 6))


LATEST = """,
latest AS (SELECT user_id AS basket, max(session_id) AS session_id FROM (
  SELECT user_id, session_id, ts, max(ts) OVER (PARTITION BY user_id) AS newest FROM interactions) WHERE ts = newest GROUP BY 1),
wanted AS (SELECT DISTINCT user_id AS basket, product_id AS item FROM interactions i JOIN latest l
  ON l.basket = i.user_id AND l.session_id = i.session_id)"""


def latest_sessions(shop) -> DataFrame:
    """The items of every user's most recent session."""
    rows = shop.interactions.select("user_id", "session_id", "product_id", "ts")
    newest = rows.groupBy("user_id").agg(F.max(F.struct("ts", "session_id")).alias("m")).select("user_id", "m.session_id")
    return rows.join(newest, ["user_id", "session_id"], "left_semi").select(
        F.col("user_id").alias("basket"), F.col("product_id").alias("item")
    ).distinct()


def _basket_sql(measure: str) -> str:
    return f"""WITH {RULES}{LATEST},
summed AS (SELECT basket, other_id, round(sum({measure}), 6) AS score FROM wanted JOIN rules ON item_id = item GROUP BY 1, 2),
fresh AS (SELECT s.* FROM summed s ANTI JOIN wanted w ON w.basket = s.basket AND w.item = s.other_id)
SELECT basket, other_id, score, row_number() OVER (PARTITION BY basket ORDER BY score DESC, other_id) AS rank FROM fresh
QUALIFY rank <= 10"""


def _register_basket(measure: str) -> None:
    @query(f"j9_basket_recommendation_{measure}", "interactions", _basket_sql(measure))
    def _(shop):
        scores = user_rules(shop).select("item_id", "other_id", F.col(measure).alias("score"))
        return B.recommend(latest_sessions(shop), scores)


for _measure in ("jaccard", "lift", "confidence"):
    _register_basket(_measure)

SHARED = """
kept AS (SELECT DISTINCT user_id, product_id AS item FROM interactions WHERE interaction_type IN ('purchase', 'add_to_cart')),
freq AS (SELECT item, count(*) AS n FROM kept GROUP BY 1),
shared AS (SELECT x.item AS item_id, y.item AS other_id, count(*) AS together FROM kept x JOIN kept y USING (user_id)
           WHERE x.item <> y.item GROUP BY 1, 2 HAVING count(*) >= 2),
buyers AS (SELECT item_id, other_id, CAST(together AS DOUBLE) / (f.n + g.n - together) AS score
           FROM shared JOIN freq f ON f.item = item_id JOIN freq g ON g.item = other_id)"""


@query("j10_shared_buyers", "interactions", f"WITH {SHARED} SELECT item_id, other_id, score FROM buyers")
def _(shop):
    return B.shared_buyers(shop.interactions)


TOP_PARTNERS_SQL = f"""WITH {RULES} SELECT item_id, other_id, round(jaccard, 6) AS score,
row_number() OVER (PARTITION BY item_id ORDER BY round(jaccard, 6) DESC, other_id) AS rank FROM rules QUALIFY rank <= 10"""


@query("g2_top_partners", "interactions", TOP_PARTNERS_SQL)
def top_partners(shop):
    baskets = user_baskets(shop)
    scores = B.jaccard(baskets, B.cooccurrence(baskets)).withColumn("score", F.round("score", 6))
    return B.top_partners(scores)
