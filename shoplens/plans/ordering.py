"""Ranking, split, sample, percentile and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens.functions.ordered import dense_index
from shoplens.functions.scalars import stamp
from shoplens.operators import baskets as B
from shoplens.operators import ordering as O
from shoplens.plans.baskets import BASKETS, RULES, user_rules
from shoplens.plans.registry import query

TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"


@query(
    "g1_recent_rows", "interactions",
    f"""SELECT user_id, product_id, session_id, {TS}, row_number() OVER (PARTITION BY user_id ORDER BY interactions.ts DESC, session_id,
product_id, line) AS rank FROM interactions QUALIFY rank <= 5""",
)
def _(shop):
    rows = O.recent(shop.interactions, "user_id", 5, ties=["session_id", "product_id", "line"])
    return rows.select("user_id", "product_id", "session_id", stamp("ts").alias("ts"), "rank")


@query("g3_most_common", "interactions", "SELECT product_id, count(*) AS n FROM interactions GROUP BY 1 ORDER BY n DESC, product_id LIMIT 20")
def _(shop):
    return O.most_common(shop.interactions, "product_id", 20)


LISTS = RULES + """,
l AS MATERIALIZED (SELECT item_id, other_id, row_number() OVER (PARTITION BY item_id ORDER BY round(jaccard, 6) DESC, other_id) AS rank FROM rules QUALIFY rank <= 10),
r AS MATERIALIZED (SELECT item_id, other_id, row_number() OVER (PARTITION BY item_id ORDER BY together DESC, other_id) AS rank FROM rules QUALIFY rank <= 10)"""


def two_lists(shop):
    rules = user_rules(shop)
    return B.top_partners(rules.withColumn("score", F.round("jaccard", 6))), B.top_partners(rules, score="together")


@query(
    "g4_rank_moves", "interactions",
    f"""WITH {LISTS}, m AS (SELECT item_id, other_id, l.rank AS rank_before, r.rank AS rank_after, l.rank - r.rank AS move
FROM l JOIN r USING (item_id, other_id) WHERE abs(l.rank - r.rank) >= 2)
SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY abs(move) DESC, other_id) AS place FROM m QUALIFY place <= 3""",
)
def _(shop):
    return O.rank_moves(*two_lists(shop), "item_id", "other_id")


@query(
    "g5_ordered_split", "clickstream",
    """SELECT event_id, row_number() OVER (ORDER BY ts, event_id) <= floor(count(*) OVER () * 0.8e0) AS is_train FROM clickstream""",
)
def _(shop):
    return O.ordered_split(shop.clickstream.select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "is_train")


def md5_number(text: str, start: int = 1) -> str:
    return f"CAST('0x' || substr(md5({text}), {start}, 15) AS BIGINT)"


@query("g6_random_split", "clickstream", f"""SELECT event_id, {md5_number("event_id || '|42'")} % 100 < 80 AS is_train FROM clickstream""")
def _(shop):
    return O.random_split(shop.clickstream.select("event_id"), ["event_id"])


@query(
    "g7_sample", "clickstream",
    f"""SELECT event_id, user_id FROM clickstream ORDER BY {md5_number("event_id || '|42'")}, event_id LIMIT 2000""",
)
def _(shop):
    return O.sample_rows(shop.clickstream.select("event_id", "user_id"), "event_id", 2000)


@query(
    "g8_latest_record", "clickstream",
    f"""SELECT user_id, event_id, event_type, {TS} FROM clickstream QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY clickstream.ts DESC, event_id DESC) = 1""",
)
def _(shop):
    rows = O.latest(shop.clickstream.select("user_id", "event_id", "event_type", "ts"), ["user_id"], "ts", "event_id")
    return rows.select("user_id", "event_id", "event_type", stamp("ts").alias("ts"))


@query(
    "g9_recent_categories", "interactions products",
    """WITH r AS (SELECT user_id, product_id FROM interactions
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, session_id, product_id, line) <= 10),
c AS (SELECT user_id, category, count(*) AS n FROM r JOIN products USING (product_id) GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, category) AS rank FROM c QUALIFY rank <= 3""",
)
def _(shop):
    return O.recent_categories(shop.interactions, shop.products)


NEAREST = ", ".join(f"CASE WHEN n > 10 THEN v[CAST(floor({q}e0 * n) AS BIGINT) + 1] END AS {p}" for p, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)))


@query(
    "g10_nearest_percentiles", "metrics",
    f"""WITH g AS (SELECT model_version, list_sort(list(metric_value)) AS v, count(*) AS n FROM metrics WHERE metric_name = 'latency_ms' GROUP BY 1)
SELECT model_version, n AS n_values, {NEAREST} FROM g""",
)
def _(shop):
    return O.nearest_percentiles(shop.metrics.where("metric_name = 'latency_ms'"), "metric_value", ["model_version"])


@query(
    "g11_dense_ids", "interactions",
    "SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS user_idx FROM (SELECT DISTINCT user_id FROM interactions)",
)
def _(shop):
    return dense_index(shop.interactions, "user_id", "user_idx")


@query(
    "h2_list_changes", "interactions",
    f"""WITH {LISTS} SELECT item_id, other_id, CASE WHEN l.rank IS NULL THEN 'added' ELSE 'removed' END AS change
FROM l FULL JOIN r USING (item_id, other_id) WHERE l.rank IS NULL OR r.rank IS NULL""",
)
def _(shop):
    return O.list_changes(*two_lists(shop), ["item_id", "other_id"])


@query(
    "h3_overlap", "interactions",
    f"""WITH {LISTS} SELECT item_id, count(*) AS length, count(r.rank) AS common, count(r.rank) / count(*) AS share
FROM l LEFT JOIN r USING (item_id, other_id) GROUP BY 1""",
)
def _(shop):
    return O.overlap(*two_lists(shop), "item_id", "other_id")


@query("h4_distinct_basket", "interactions", f"WITH {BASKETS} SELECT basket, item FROM kept")
def _(shop):
    return shop.interactions.where(F.col("interaction_type").isin("purchase", "add_to_cart")).select(
        F.col("user_id").alias("basket"), F.col("product_id").alias("item")
    ).distinct()


@query("h5_foreign_values", "users", "SELECT DISTINCT income_level FROM users WHERE income_level NOT IN ('low', 'medium', 'high')")
def _(shop):
    return O.foreign_values(shop.users, "income_level", ["low", "medium", "high"])
