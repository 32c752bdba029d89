"""The user-item relation and its factorisation. The relation stays in long form; no wide or dense matrix is built."""

from __future__ import annotations

import time
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoplens.functions.ordered import dense_index
from shoplens.functions.scalars import dot, norm
from shoplens.operators.alternating import Factors, alternate
from shoplens.session import shared_folder
from shoplens.sources.sinks import keep, remove

# fixed values: the trainer's defaults
RANK, ITERATIONS, REGULARISATION, SEED = 100, 20, 0.1, 42
# the trainer deletes the shuffle files behind a checkpoint: after every iteration, one iteration's files are the most it keeps
CHECKPOINT_EVERY = 1
SMALL_WORK = 1 << 26


def rating_matrix(interactions: DataFrame) -> DataFrame:
    """Summed ratings per pair, a missing rating counting 1."""
    return interactions.groupBy("user_id", "product_id").agg(F.sum(F.coalesce(F.col("rating"), F.lit(1.0))).alias("value"))


def mean_matrix(interactions: DataFrame) -> DataFrame:
    return interactions.where(F.col("rating").isNotNull()).groupBy("user_id", "product_id").agg(F.avg("rating").alias("value"))


def binary_matrix(interactions: DataFrame) -> DataFrame:
    return interactions.select("user_id", "product_id").distinct().withColumn("value", F.lit(1))


def matrix_info(matrix: DataFrame) -> DataFrame:
    """Shape, stored and non-zero entries, sparsity."""
    cells = F.col("n_users") * F.col("n_items")
    return matrix.agg(
        F.countDistinct("user_id").alias("n_users"), F.countDistinct("product_id").alias("n_items"),
        F.count(F.lit(1)).alias("stored"), F.count_if(F.col("value") != 0).alias("non_zero"),
    ).withColumn("sparsity", F.lit(1.0) - F.col("stored") / cells)


@dataclass(frozen=True)
class Centred:
    """A rating relation without its means: residual (user_no, item_no, residual), and the ids and biases of both sides."""

    residual: DataFrame
    users: DataFrame
    items: DataFrame
    mean: DataFrame


def centre(matrix: DataFrame) -> Centred:
    """Take out the overall mean, a bias per user and a bias per item, and number both sides, because the trainer takes int ids
    only. Everything is checkpointed once, for all fits and their errors, and so are the ratings, which every step here reads."""
    shared_folder(matrix.sparkSession)
    rated = matrix.where(F.col("value") != 0).checkpoint()
    overall = rated.agg(F.avg("value").alias("m")).scalar()
    centred = rated.withColumn("r", F.col("value") - overall)
    users = centred.groupBy("user_id").agg(F.avg("r").alias("user_bias")).join(dense_index(rated, "user_id", "user_no"), "user_id").checkpoint()
    by_user = centred.join(users, "user_id").withColumn("r", F.col("r") - F.col("user_bias"))
    items = by_user.groupBy("product_id").agg(F.avg("r").alias("item_bias")).join(dense_index(rated, "product_id", "item_no"), "product_id").checkpoint()
    residual = by_user.join(items, "product_id").select(F.col("user_no").cast("int"), F.col("item_no").cast("int"), (F.col("r") - F.col("item_bias")).alias("residual"))
    return Centred(residual.checkpoint(), users, items, rated.agg(F.avg("value").alias("global_bias")))


def train_als(centred: Centred, rank: int = RANK, iterations: int = ITERATIONS, regularisation: float = REGULARISATION, seed: int = SEED):
    """A model of the residual without bias terms, whose penalty is scaled by each row's count, hence factors differ from a
    constant-penalty solver in value, not in use.

    The library's trainer takes rank x rank steps for each rating and rank cubed for each row, one row at a time, and a fixed number of
    blocks: beyond SMALL_WORK such steps an iteration the same equations are solved in blocks.
    """
    from pyspark.ml.recommendation import ALS

    sizes = centred.residual.agg(F.count(F.lit(1)).alias("n"), (F.max("user_no") + 1).alias("users"), (F.max("item_no") + 1).alias("items")).first()
    if sizes.n and sizes.n * rank**2 + (sizes.users + sizes.items) * rank**3 > SMALL_WORK:
        return alternate(centred.residual, sizes.n, sizes.users, sizes.items, rank, iterations, regularisation, seed)
    trainer = ALS(
        rank=rank, maxIter=iterations, regParam=regularisation, seed=seed, userCol="user_no", itemCol="item_no",
        ratingCol="residual", coldStartStrategy="drop", checkpointInterval=CHECKPOINT_EVERY,
    )
    return trainer.fit(centred.residual.withColumn("residual", F.col("residual").cast("float")))


def fit_errors(centred: Centred, model) -> DataFrame:
    """Root mean squared errors with factors (rmse) and with means alone (plain_rmse), one row."""
    root = lambda e: F.sqrt(F.avg(e * e))
    if isinstance(model, Factors):  # its last half-step met every rating with both factors
        plain = centred.residual.agg(root(F.col("residual")).alias("e")).scalar()
        return model.errors.agg(F.sqrt(F.sum("squares") / F.sum("ratings")).alias("rmse")).withColumn("plain_rmse", plain)
    users = model.userFactors.select(F.col("id").alias("user_no"), F.col("features").alias("_u"))
    items = model.itemFactors.select(F.col("id").alias("item_no"), F.col("features").alias("_v"))
    left = F.col("residual") - dot(F.col("_u"), F.col("_v"))
    return centred.residual.join(users, "user_no").join(items, "item_no").agg(root(left).alias("rmse"), root(F.col("residual")).alias("plain_rmse"))


def factors_of(centred: Centred, model) -> tuple[DataFrame, DataFrame]:
    """(user_id, user_vector, user_bias) and (product_id, item_vector, item_bias)."""
    users = model.userFactors.select(F.col("id").cast("long").alias("user_no"), F.col("features").alias("user_vector"))
    items = model.itemFactors.select(F.col("id").cast("long").alias("item_no"), F.col("features").alias("item_vector"))
    return users.join(centred.users, "user_no").select("user_id", "user_vector", "user_bias"), items.join(centred.items, "item_no").select("product_id", "item_vector", "item_bias")


def fit_als(matrix: DataFrame, rank: int = RANK, iterations: int = ITERATIONS, regularisation: float = REGULARISATION, seed: int = SEED):
    """Factors for the residual after a user and an item bias, the biases, and the overall mean."""
    centred = centre(matrix)
    return *factors_of(centred, train_als(centred, rank, iterations, regularisation, seed)), centred.mean


def bias_losses(matrix: DataFrame, penalties: Mapping[str, float], sweeps: int) -> DataFrame:
    """(run, step, loss): the training of the bias terms, alternating between users and items, for several penalties at once.

    Step 0 has the overall mean alone. Every further step fits one side to what the other leaves: the sum of a row's residuals
    over their count plus the penalty. The loss is the mean squared error over all non-zero entries.

    The entries are written once, and a step is one pass over them, whose shuffle files go with it: count, sum and sum of squares
    of a user's or item's residuals give its bias and its squared error. One row of losses per step reaches the driver.
    """
    spark = matrix.sparkSession
    rated, folder = keep(matrix.where(F.col("value") != 0).select("user_id", "product_id", "value"), "ratings")
    overall = F.lit(rated.agg(F.avg("value")).first()[0]).cast("double")
    rows = rated.select("user_id", "product_id", (F.col("value") - overall).alias("centred"))
    start = rows.agg(F.avg(F.col("centred") * F.col("centred"))).first()[0]
    losses, biases, folders = [(run, 0, start) for run in penalties], {}, {}
    for step in range(sweeps):
        key, other = ("user_id", "product_id") if step % 2 == 0 else ("product_id", "user_id")
        current = rows.join(biases[other], other) if other in biases else rows
        error = {run: F.col("centred") - F.col(f"{other}_{run}") if other in biases else F.col("centred") for run in penalties}
        sums = current.groupBy(key).agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(e).alias(f"sum_{run}") for run, e in error.items()], *[F.sum(e * e).alias(f"squares_{run}") for run, e in error.items()],
        )
        fitted = {run: F.col(f"sum_{run}") / (F.col("n") + F.lit(float(penalty))) for run, penalty in penalties.items()}
        left = {run: F.col(f"squares_{run}") - F.lit(2.0) * b * F.col(f"sum_{run}") + F.col("n") * b * b for run, b in fitted.items()}
        side, path = keep(
            sums.where(F.col(key).isNotNull()).select(
                key, "n", *[b.alias(f"{key}_{run}") for run, b in fitted.items()], *[F.greatest(e, F.lit(0.0)).alias(f"left_{run}") for run, e in left.items()]
            ),
            "biases",
        )
        found = side.agg(*[(F.sum(f"left_{run}") / F.sum("n")).alias(run) for run in penalties]).first()
        losses += [(run, step + 1, found[run]) for run in penalties]
        if key in folders:
            remove(spark, folders[key])
        biases[key], folders[key] = side.drop("n", *[f"left_{run}" for run in penalties]), path
    for path in (folder, *folders.values()):
        remove(spark, path)
    return spark.createDataFrame(losses, "run string, step int, loss double")


def bias_terms(matrix: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """One alternating sweep of mean residuals over non-zero entries: users first, items given the users."""
    rated = with_dot(matrix.where(F.col("value") != 0), users, items)
    user_bias = rated.groupBy("user_id").agg(F.avg(F.col("value") - F.col("dot")).alias("bias"))
    item_bias = rated.join(user_bias, "user_id").groupBy("product_id").agg(F.avg(F.col("value") - F.col("bias") - F.col("dot")).alias("bias"))
    return user_bias.select(F.lit("user").alias("entity"), F.col("user_id").alias("id"), "bias").unionByName(
        item_bias.select(F.lit("item").alias("entity"), F.col("product_id").alias("id"), "bias")
    )


def with_dot(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs with the inner product of their factors; pairs without factors are dropped. Factors have (id, vector)."""
    u = users.select(F.col("id").alias("user_id"), F.col("vector").alias("_u"))
    v = items.select(F.col("id").alias("product_id"), F.col("vector").alias("_v"))
    return pairs.join(u, "user_id").join(v, "product_id").withColumn("dot", dot(F.col("_u"), F.col("_v"))).drop("_u", "_v")


def predict(pairs: DataFrame, users: DataFrame, items: DataFrame, biases: DataFrame | None = None, global_bias: float = 0.0) -> DataFrame:
    out = with_dot(pairs, users, items)
    total = F.col("dot") + F.lit(global_bias)
    if biases is not None:
        for entity, key in (("user", "user_id"), ("item", "product_id")):
            part = biases.where(F.col("entity") == entity).select(F.col("id").alias(key), F.col("bias").alias(f"{entity}_bias"))
            out = out.join(part, key, "left")
            total = total + F.coalesce(F.col(f"{entity}_bias"), F.lit(0.0))
    return out.withColumn("prediction", total)


def squared_norms(factors: DataFrame) -> Column:
    return factors.agg(F.sum(F.pow(norm(F.col("vector")), F.lit(2.0))).alias("s")).scalar()


def objective(predicted: DataFrame, users: DataFrame, items: DataFrame, regularisation: float = REGULARISATION) -> DataFrame:
    """Mean squared error plus the penalty on all factors."""
    error = predicted.agg(F.avg(F.pow(F.col("value") - F.col("prediction"), F.lit(2.0))).alias("mse"))
    penalty = F.lit(regularisation) * (squared_norms(users) + squared_norms(items))
    return error.withColumn("penalty", penalty).withColumn("objective", F.col("mse") + F.col("penalty"))


def compare_ranks(matrix: DataFrame, ranks: Iterable[int], iterations: int, regularisation: float = REGULARISATION) -> DataFrame:
    """One fit per rank on the same residual: training seconds and root mean squared error, beside that of the means alone."""
    centred, out = centre(matrix), []
    for rank in ranks:
        start = time.monotonic()
        model = train_als(centred, rank, iterations, regularisation)
        seconds = time.monotonic() - start
        out.append(fit_errors(centred, model).select(F.lit(rank).alias("rank"), F.lit(iterations).alias("iterations"), F.lit(seconds).alias("training_seconds"), "rmse", "plain_rmse"))
    return reduce(DataFrame.unionByName, out)


def training_curve(losses: DataFrame) -> DataFrame:
    """(run, step, loss) with improvement on the first step and change from the previous one; steps per run are few."""
    w = W.partitionBy("run").orderBy("step")
    first, previous = F.first("loss").over(w), F.lag("loss").over(w)
    return losses.withColumns(
        {
            "improvement": first - F.col("loss"),
            "improvement_pct": (first - F.col("loss")) / first * F.lit(100.0),
            "change": F.col("loss") - previous,
            "convergence": F.when(previous > 0, F.abs(F.col("loss") - previous) / previous),
        }
    )


def training_summary(losses: DataFrame) -> DataFrame:
    """Final loss, total improvement and the spread of the last five losses per run."""
    ordered = F.array_sort(F.collect_list(F.struct("step", "loss")))
    runs = losses.groupBy("run").agg(F.transform(ordered, lambda e: e["loss"]).alias("l"))
    last = F.slice("l", F.greatest(F.size("l") - 4, F.lit(1)), 5)
    mean = F.aggregate("last5", F.lit(0.0), lambda a, x: a + x) / F.size("last5")
    return runs.withColumn("last5", last).select(
        "run", F.element_at("l", -1).alias("final_loss"), (F.element_at("l", 1) - F.element_at("l", -1)).alias("total_improvement"),
        F.when(
            F.size("l") >= 5,
            F.sqrt(F.aggregate("last5", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size("last5")),
        ).otherwise(F.lit(0.0)).alias("stability"),
    )


def factor_statistics(factors: DataFrame) -> DataFrame:
    """Spread of the factor values and of the vector lengths."""
    values = factors.select(F.explode("vector").alias("x")).select(F.col("x").cast("double").alias("x"))
    lengths = factors.select(norm(F.col("vector")).alias("length"))
    a = values.agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("low"), F.max("x").alias("high"))
    b = lengths.agg(F.struct(F.avg("length").alias("mean_length"), F.max("length").alias("max_length")).alias("l")).scalar()
    return a.withColumn("_l", b).select("*", "_l.*").drop("_l")


def best_run(runs: DataFrame, metric: str, smallest: bool = True) -> DataFrame:
    pick = F.min_by if smallest else F.max_by
    rows = runs.where(F.col("metric") == metric)
    return rows.agg(pick("run", F.struct("value", "run")).alias("run"), (F.min if smallest else F.max)("value").alias("value"))
