"""Recommendation and evaluation queries on given factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens.operators import baskets as B
from shoplens.operators import evaluate as V
from shoplens.operators import recommend as R
from shoplens.operators.joins import enrich
from shoplens.plans.baskets import RULES, user_baskets
from shoplens.plans.factors import FACTORED, LOSSES, losses, predicted, rounded
from shoplens.plans.ordering import md5_number
from shoplens.plans.registry import query

FACTORS = "user_factors item_factors"
SCORED = """
scored AS (SELECT u.id AS user_id, i.id AS product_id, round(list_dot_product(u.vector, i.vector), 6) AS score FROM user_factors u, item_factors i),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, product_id) AS rank FROM scored),
unseen AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, product_id) AS rank FROM scored s
  WHERE NOT EXISTS (SELECT 1 FROM interactions x WHERE x.user_id = s.user_id AND x.product_id = s.product_id))"""


def top(shop, k, fresh=False):
    return R.personal(shop.user_factors, shop.item_factors, k, shop.interactions if fresh else None)


@query("o1_personal_top", FACTORS + " interactions", f"WITH {SCORED} SELECT * FROM unseen WHERE rank <= 10")
def _(shop):
    return top(shop, 10, fresh=True)


@query("o3_candidates", FACTORS + " interactions", f"WITH {SCORED} SELECT * FROM ranked WHERE rank <= 50")
def _(shop):
    return top(shop, 50)


@query(
    "o4_user_history", "users products interactions",
    """WITH c AS (SELECT user_id, interaction_type, count(*) AS n FROM interactions GROUP BY 1, 2),
b AS (SELECT user_id, CAST(sum(n) AS BIGINT) AS total_interactions, string_agg(interaction_type || ':' || n, ',' ORDER BY interaction_type) AS breakdown FROM c GROUP BY 1),
r AS (SELECT user_id, product_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, session_id, product_id, line) AS k FROM interactions QUALIFY k <= 5),
l AS (SELECT user_id, string_agg(name, '; ' ORDER BY k) AS last_products FROM r JOIN products USING (product_id) GROUP BY 1)
SELECT user_id, age, gender, location, income_level, total_interactions, breakdown, last_products FROM users
LEFT JOIN b USING (user_id) LEFT JOIN l USING (user_id)""",
)
def _(shop):
    who = shop.users.select("user_id", "age", "gender", "location", "income_level")
    return R.history(who, shop.interactions, shop.products)


STATS = """
described AS (SELECT u.user_id, u.product_id, price, rating, category FROM unseen u JOIN products p USING (product_id) WHERE rank <= 10),
cats AS (SELECT user_id, string_agg(category || ':' || n, ',' ORDER BY category) AS categories FROM
  (SELECT user_id, category, count(*) AS n FROM described GROUP BY 1, 2) GROUP BY 1),
stats AS (SELECT user_id, count(*) AS items, min(price) AS min_price, max(price) AS max_price,
  CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_price, CAST(sum(CAST(rating AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_rating,
  count(*) FILTER (rating >= 4.0) / count(*) AS high_quality_share FROM described GROUP BY 1),
past AS (SELECT user_id, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS historical_price
  FROM interactions JOIN products USING (product_id) GROUP BY 1),
matched AS (SELECT user_id, avg_price, historical_price, abs(avg_price - historical_price) / historical_price AS deviation FROM stats JOIN past USING (user_id))"""
BAND = "CASE WHEN deviation < 0.2e0 THEN 'excellent' WHEN deviation < 0.4e0 THEN 'good' ELSE 'poor' END AS price_match"


@query("e14_list_statistics", FACTORS + " interactions products", f"WITH {SCORED}, {STATS} SELECT * FROM stats JOIN cats USING (user_id)")
def _(shop):
    return R.list_statistics(top(shop, 10, fresh=True), shop.products)


@query("e15_price_match", FACTORS + " interactions products", f"WITH {SCORED}, {STATS} SELECT *, {BAND} FROM matched")
def _(shop):
    stats = R.list_statistics(top(shop, 10, fresh=True), shop.products)
    return R.price_match(stats, shop.interactions, shop.products)


@query(
    "o5_insights", FACTORS + " interactions products",
    f"WITH {SCORED}, {STATS} SELECT s.*, categories, deviation, {BAND} FROM stats s JOIN cats USING (user_id) JOIN matched m USING (user_id)",
)
def _(shop):
    stats = R.list_statistics(top(shop, 10, fresh=True), shop.products)
    return stats.join(R.price_match(stats, shop.interactions, shop.products).select("user_id", "deviation", "price_match"), "user_id")


@query(
    "o6_list_changes", FACTORS + " interactions",
    f"""WITH {SCORED}, a AS (SELECT * FROM ranked WHERE rank <= 10), b AS (SELECT * FROM unseen WHERE rank <= 10)
SELECT user_id, product_id, a.score AS score_left, b.score AS score_right, b.score - a.score AS score_change,
CASE WHEN a.score IS NULL THEN 'added' WHEN b.score IS NULL THEN 'removed' ELSE 'kept' END AS change FROM a FULL JOIN b USING (user_id, product_id)""",
)
def _(shop):
    return R.changes(top(shop, 10), top(shop, 10, fresh=True))


@query(
    "o6_session_categories", "interactions products",
    "SELECT session_id, category, count(*) AS n FROM interactions JOIN products USING (product_id) GROUP BY 1, 2",
)
def _(shop):
    return R.session_categories(shop.interactions, shop.products)


@query(
    "o7_bought_together", "interactions products",
    f"""WITH {RULES}, t AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY together DESC, other_id) AS rank FROM rules QUALIFY rank <= 5)
SELECT f.item AS item_id, f.frequency, CAST(f.frequency AS DOUBLE) / n AS support, other_id, together, confidence, rank, name, price
FROM freq f CROSS JOIN total LEFT JOIN t ON t.item_id = f.item LEFT JOIN products ON product_id = other_id""",
)
def _(shop):
    baskets = user_baskets(shop)
    found = B.profile(baskets, B.associations(baskets, B.cooccurrence(baskets)), 5)
    return enrich(found, shop.products, "other_id").select(
        "item_id", "frequency", "support", "other_id", "together", "confidence", "rank", "name", "price"
    )


@query(
    "o8_cold_start", "users products interactions",
    """WITH pop AS (SELECT product_id, round(sum(CASE interaction_type WHEN 'view' THEN 0.1e0 WHEN 'add_to_cart' THEN 0.5e0 ELSE 1e0 END
  * exp(-0.6931471805599453e0 * date_diff('day', CAST(ts AS DATE), DATE '2001-12-01') / 180e0)), 6) AS score FROM interactions GROUP BY 1),
popular AS (SELECT product_id, score, category AS own FROM pop JOIN products USING (product_id)),
first AS (SELECT own AS category, product_id, score, 0 AS fill FROM popular WHERE own IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY own ORDER BY score DESC, product_id) <= 10),
shop AS (SELECT * FROM popular ORDER BY score DESC, product_id LIMIT 10),
wanted AS (SELECT DISTINCT coalesce(preference_category, '*') AS category FROM users),
best AS (SELECT category, product_id, score, row_number() OVER (PARTITION BY category ORDER BY fill, score DESC, product_id) AS rank
  FROM (SELECT * FROM first UNION ALL SELECT category, product_id, score, 1 FROM wanted, shop WHERE own IS DISTINCT FROM category) QUALIFY rank <= 10),
active AS (SELECT user_id FROM interactions GROUP BY 1 HAVING count(*) >= 30)
SELECT user_id, b.category, product_id, score, rank FROM users u JOIN best b ON b.category = coalesce(u.preference_category, '*')
WHERE user_id NOT IN (SELECT user_id FROM active)""",
)
def _(shop):
    return R.cold_start(shop.users, shop.interactions, shop.products, shop.now, min_history=30)


@query(
    "o9_experiment", "clickstream",
    f"""WITH u AS (SELECT user_id, {md5_number("user_id || '|exp'")} % 2 AS arm, count(*) FILTER (event_type = 'view') AS v,
count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'purchase') AS p FROM clickstream GROUP BY 1),
g AS (SELECT arm, count(*) AS users, CAST(sum(v) AS DOUBLE) AS v, CAST(sum(c) AS DOUBLE) AS c, CAST(sum(p) AS DOUBLE) AS p FROM u GROUP BY 1),
b AS (SELECT v AS v0, c AS c0, p AS p0 FROM g WHERE arm = 0), j AS (SELECT * FROM g, b)
SELECT arm, users, CAST(v AS BIGINT) AS view, CAST(c AS BIGINT) AS click, CAST(p AS BIGINT) AS purchase, c / v AS ctr,
round(sqrt(abs(c / v * (1 - c / v)) / v), 6) AS ctr_se,
round((c / v - c0 / v0) / sqrt(abs((c + c0) / (v + v0) * (1 - (c + c0) / (v + v0))) * (1 / v + 1 / v0)), 6) AS ctr_z, p / c AS conversion,
round(sqrt(abs(p / c * (1 - p / c)) / c), 6) AS conversion_se,
round((p / c - p0 / c0) / sqrt(abs((p + p0) / (c + c0) * (1 - (p + p0) / (c + c0))) * (1 / c + 1 / c0)), 6) AS conversion_z FROM j""",
)
def _(shop):
    out = R.experiment(shop.clickstream)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith(("_se", "_z"))})


VIEWS = "interactions user_factors item_factors"


@query(
    "n3_regression_metrics", VIEWS,
    f"""WITH {FACTORED} SELECT round(sqrt(avg((value - prediction) ** 2)), 6) AS rmse, round(avg(abs(value - prediction)), 6) AS mae,
round(1 - avg((value - prediction) ** 2) / var_pop(value), 6) AS r2 FROM predicted""",
)
def _(shop):
    out = V.regression_metrics(predicted(shop))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    "n5_pair_accuracy", VIEWS,
    f"""WITH {FACTORED} SELECT round(avg((value - prediction) ** 2), 6) AS mse, round(avg(abs(value - prediction)), 6) AS mae,
round(corr(value, prediction), 6) AS correlation FROM predicted""",
)
def _(shop):
    out = V.pair_accuracy(predicted(shop))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    "n6_retrieval_quality", VIEWS,
    f"""WITH {SCORED} SELECT count(*) / (SELECT count(*) FROM user_factors) AS avg_candidates, round(avg(score), 6) AS avg_score,
count(DISTINCT product_id) AS coverage, count(DISTINCT product_id) / (SELECT count(*) FROM item_factors) AS diversity FROM ranked WHERE rank <= 20""",
)
def _(shop):
    return V.retrieval_quality(top(shop, 20), shop.item_factors, shop.user_factors).withColumn("avg_score", F.round("avg_score", 6))


@query(
    "n7_user_quality", VIEWS,
    f"""WITH {SCORED}, s AS (SELECT DISTINCT user_id, product_id, 1 AS known FROM interactions)
SELECT user_id, count(*) / 10e0 AS diversity, count(known) AS common, count(known) / count(*) AS relevance FROM ranked LEFT JOIN s USING (user_id, product_id)
WHERE rank <= 10 GROUP BY 1""",
)
def _(shop):
    return V.user_quality(top(shop, 10), shop.interactions)


@query(
    "n8_list_comparison", VIEWS + " users products",
    f"""WITH {SCORED}, l AS (SELECT 1 AS side, user_id, product_id FROM ranked WHERE rank <= 10 UNION ALL SELECT 2, user_id, product_id FROM unseen WHERE rank <= 10),
d AS (SELECT side, user_id, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS price, CAST(sum(CAST(rating AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS rating,
  count(*) FILTER (category = preference_category) AS hits FROM l JOIN products USING (product_id) JOIN users USING (user_id) GROUP BY 1, 2),
o AS (SELECT a.user_id, count(b.user_id) / count(*) * 100 AS overlap_pct FROM l a LEFT JOIN l b ON b.side = 2 AND b.user_id = a.user_id AND b.product_id = a.product_id
  WHERE a.side = 1 GROUP BY 1)
SELECT user_id, overlap_pct, x.price AS first_price, x.rating AS first_rating, x.hits AS first_hits, y.price AS second_price, y.rating AS second_rating, y.hits AS second_hits,
CASE WHEN y.hits > x.hits THEN 'improved' WHEN y.hits < x.hits THEN 'reduced' ELSE 'same' END AS preference,
CASE WHEN y.price - x.price > 50 THEN 'higher' WHEN y.price - x.price < -50 THEN 'lower' ELSE 'similar' END AS price,
CASE WHEN y.rating - x.rating > 0.1e0 THEN 'improved' WHEN y.rating - x.rating < -0.1e0 THEN 'reduced' ELSE 'similar' END AS quality
FROM o JOIN d x USING (user_id) JOIN d y USING (user_id) WHERE x.side = 1 AND y.side = 2""",
)
def _(shop):
    return V.compare_lists(top(shop, 10), top(shop, 10, fresh=True), shop.users, shop.products)


@query(
    "n9_metric_differences", "interactions",
    f"""WITH {LOSSES}, r AS (SELECT run, 'loss_' || step AS metric, loss AS value FROM losses)
SELECT metric, round(a.value, 6) AS value_left, round(b.value, 6) AS value_right, round(b.value - a.value, 6) AS value_change FROM (SELECT * FROM r WHERE run = 'free') a
JOIN (SELECT * FROM r WHERE run = 'damped') b USING (metric)""",
)
def _(shop):
    """The losses of two training runs, step by step."""
    runs = losses(shop).select("run", F.concat(F.lit("loss_"), F.col("step").cast("string")).alias("metric"), F.col("loss").alias("value"))
    return rounded(V.metric_differences(runs, "free", "damped"), "value_left", "value_right", "value_change")


@query(
    "n10_ranking_metrics", VIEWS,
    f"""WITH {SCORED}, rel AS (SELECT DISTINCT user_id, product_id, 1 AS hit FROM interactions),
t AS (SELECT user_id, count(*) AS relevant FROM rel GROUP BY 1),
g AS (SELECT user_id, count(hit) AS hits, sum(CASE WHEN hit = 1 THEN 1e0 / log2(rank + 1) ELSE 0 END) AS dcg FROM ranked LEFT JOIN rel USING (user_id, product_id)
  WHERE rank <= 10 GROUP BY 1)
SELECT user_id, hits / 10e0 AS precision, hits / relevant AS recall, round(dcg / (SELECT sum(1e0 / log2(i + 1)) FROM range(1, 11) r(i) WHERE i <= relevant), 6) AS ndcg
FROM g JOIN t USING (user_id)""",
)
def _(shop):
    relevant = shop.interactions.select("user_id", "product_id").distinct()
    return V.ranking_metrics(top(shop, 10), relevant).withColumn("ndcg", F.round("ndcg", 6))
