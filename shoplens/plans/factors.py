"""Queries on the user-item relation and its factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens.operators import factors as M
from shoplens.operators.joins import index_maps
from shoplens.plans.registry import query

MATRIX = "matrix AS (SELECT user_id, product_id, sum(coalesce(rating, 1)) AS value FROM interactions GROUP BY 1, 2)"
FACTORED = MATRIX + """,
rated AS (SELECT user_id, product_id, value, list_dot_product(u.vector, i.vector) AS dot FROM matrix
  JOIN user_factors u ON u.id = user_id JOIN item_factors i ON i.id = product_id),
ub AS (SELECT user_id, avg(value - dot) AS b FROM rated GROUP BY 1),
ib AS (SELECT product_id, avg(value - b - dot) AS b FROM rated JOIN ub USING (user_id) GROUP BY 1),
predicted AS (SELECT user_id, product_id, value, dot + ub.b + ib.b AS prediction FROM rated JOIN ub USING (user_id) JOIN ib USING (product_id))"""
VIEWS = "interactions user_factors item_factors"


@query(
    "l1_index_maps", "interactions",
    """SELECT 'user' AS entity, user_id AS id, row_number() OVER (ORDER BY user_id) - 1 AS idx FROM (SELECT DISTINCT user_id FROM interactions)
UNION ALL SELECT 'item', product_id, row_number() OVER (ORDER BY product_id) - 1 FROM (SELECT DISTINCT product_id FROM interactions)""",
)
def _(shop):
    users, items = index_maps(shop.interactions)
    return users.select(F.lit("user").alias("entity"), F.col("user_id").alias("id"), F.col("user_idx").alias("idx")).unionByName(
        items.select(F.lit("item").alias("entity"), F.col("product_id").alias("id"), F.col("item_idx").alias("idx"))
    )


@query("l2_rating_matrix", "interactions", f"WITH {MATRIX} SELECT * FROM matrix")
def _(shop):
    return M.rating_matrix(shop.interactions)


@query("l3_mean_matrix", "interactions", "SELECT user_id, product_id, avg(rating) AS value FROM interactions WHERE rating IS NOT NULL GROUP BY 1, 2")
def _(shop):
    return M.mean_matrix(shop.interactions)


@query("l4_binary_matrix", "interactions", "SELECT DISTINCT user_id, product_id, 1 AS value FROM interactions")
def _(shop):
    return M.binary_matrix(shop.interactions)


@query(
    "l5_matrix_info", "interactions",
    f"""WITH {MATRIX} SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT product_id) AS n_items, count(*) AS stored,
count(*) FILTER (value <> 0) AS non_zero, 1e0 - count(*) / CAST(count(DISTINCT user_id) * count(DISTINCT product_id) AS DOUBLE) AS sparsity FROM matrix""",
)
def _(shop):
    return M.matrix_info(M.rating_matrix(shop.interactions))


def given_biases(shop):
    return M.bias_terms(M.rating_matrix(shop.interactions), shop.user_factors, shop.item_factors)


def predicted(shop):
    matrix = M.rating_matrix(shop.interactions)
    return M.predict(matrix, shop.user_factors, shop.item_factors, given_biases(shop))


@query(
    "l7_bias_terms", VIEWS,
    f"""WITH {FACTORED} SELECT 'user' AS entity, user_id AS id, round(b, 6) AS bias FROM ub UNION ALL SELECT 'item', product_id, round(b, 6) FROM ib""",
)
def _(shop):
    return given_biases(shop).withColumn("bias", F.round("bias", 6))


@query(
    "l8_objective", VIEWS,
    f"""WITH {FACTORED}, p AS (SELECT 0.1e0 * ((SELECT sum(list_dot_product(vector, vector)) FROM user_factors)
  + (SELECT sum(list_dot_product(vector, vector)) FROM item_factors)) AS penalty), e AS (SELECT avg((value - prediction) ** 2) AS mse FROM predicted)
SELECT round(mse, 6) AS mse, round(penalty, 6) AS penalty, round(mse + penalty, 6) AS objective FROM e, p""",
)
def _(shop):
    out = M.objective(predicted(shop), shop.user_factors, shop.item_factors)
    return out.select(*[F.round(c, 6).alias(c) for c in ("mse", "penalty", "objective")])


@query("l9_predictions", VIEWS, f"WITH {FACTORED} SELECT user_id, product_id, value, round(prediction, 6) AS prediction FROM predicted")
def _(shop):
    return predicted(shop).select("user_id", "product_id", "value", F.round("prediction", 6).alias("prediction"))


PENALTIES, SWEEPS = {"free": 0.0, "damped": 2.0, "stiff": 20.0}, 6


def _bias_training() -> str:
    """The sweeps of every run, one common table expression each."""
    parts = ["m0 AS (SELECT user_id, product_id, sum(coalesce(rating, 1)) AS value FROM interactions GROUP BY 1, 2 HAVING sum(coalesce(rating, 1)) <> 0)"]
    parts.append("s0 AS (SELECT user_id, product_id, run, penalty, value - (SELECT avg(value) FROM m0) AS c, 0e0 AS u, 0e0 AS i FROM m0, "
                 f"(VALUES {', '.join(f"('{run}', {penalty}e0)" for run, penalty in PENALTIES.items())}) p(run, penalty))")
    for step in range(1, SWEEPS + 1):
        key, new, other = ("user_id", "u", "i") if step % 2 else ("product_id", "i", "u")
        parts.append(f"s{step} AS (SELECT * REPLACE (sum(c - {other}) OVER w / (count(*) OVER w + penalty) AS {new}) FROM s{step - 1} WINDOW w AS (PARTITION BY run, {key}))")
    losses = " UNION ALL ".join(f"SELECT run, {step} AS step, avg((c - u - i) * (c - u - i)) AS loss FROM s{step} GROUP BY 1" for step in range(SWEEPS + 1))
    return ", ".join(parts) + f", losses AS ({losses})"


LOSSES = _bias_training()


def losses(shop):
    """The loss curves of the bias terms' training, one run per penalty."""
    return M.bias_losses(M.rating_matrix(shop.interactions), PENALTIES, SWEEPS)


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(
    "l11_training_curve", "interactions",
    f"""WITH {LOSSES}, w AS (SELECT *, first_value(loss) OVER (PARTITION BY run ORDER BY step) AS f, lag(loss) OVER (PARTITION BY run ORDER BY step) AS p FROM losses)
SELECT run, step, round(loss, 6) AS loss, round(f - loss, 6) AS improvement, round((f - loss) / f * 100e0, 6) AS improvement_pct, round(loss - p, 6) AS change,
round(CASE WHEN p > 0 THEN abs(loss - p) / p END, 6) AS convergence FROM w""",
)
def _(shop):
    return rounded(M.training_curve(losses(shop)), "loss", "improvement", "improvement_pct", "change", "convergence")


@query(
    "l11_training_summary", "interactions",
    f"""WITH {LOSSES}, w AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS back FROM losses)
SELECT run, round(max_by(loss, step), 6) AS final_loss, round(min_by(loss, step) - max_by(loss, step), 6) AS total_improvement,
round(CASE WHEN count(*) >= 5 THEN stddev_pop(loss) FILTER (back <= 5) ELSE 0 END, 6) AS stability FROM w GROUP BY 1""",
)
def _(shop):
    return rounded(M.training_summary(losses(shop)), "final_loss", "total_improvement", "stability")


@query(
    "l12_factor_statistics", "item_factors",
    """SELECT round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, min(x) AS low, max(x) AS high,
(SELECT round(avg(sqrt(list_dot_product(vector, vector))), 6) FROM item_factors) AS mean_length,
(SELECT round(max(sqrt(list_dot_product(vector, vector))), 6) FROM item_factors) AS max_length
FROM (SELECT unnest(vector) AS x FROM item_factors)""",
)
def _(shop):
    out = M.factor_statistics(shop.item_factors)
    return out.select(*[F.round(c, 6).alias(c) if c not in ("low", "high") else F.col(c) for c in out.columns])


@query(
    "l13_best_run", "interactions",
    f"""WITH {LOSSES}, r AS (SELECT run, loss AS value FROM losses QUALIFY row_number() OVER (PARTITION BY run ORDER BY step DESC) = 1)
SELECT run, round(value, 6) AS value FROM r ORDER BY value, run LIMIT 1""",
)
def _(shop):
    """The run whose training ends at the smallest loss."""
    ends = losses(shop).groupBy("run").agg(F.max_by("loss", "step").alias("value")).withColumn("metric", F.lit("loss"))
    return rounded(M.best_run(ends, "loss"), "value")
