"""Accuracy and list quality, model against model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.operators.joins import align
from shoplens.operators.ordering import overlap
from shoplens.operators.recommend import list_statistics


def regression_metrics(df: DataFrame, actual: str = "value", predicted: str = "prediction") -> DataFrame:
    """RMSE, MAE and R-squared. The total sum of squares is around the mean, from the count, sum and sum of squares
    of the deviations, in one pass (population variance)."""
    error = F.col(actual) - F.col(predicted)
    return df.agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
        (F.lit(1.0) - F.avg(error * error) / F.var_pop(actual)).alias("r2"),
    )


def pair_accuracy(df: DataFrame, actual: str = "value", predicted: str = "prediction") -> DataFrame:
    error = F.col(actual) - F.col(predicted)
    return df.agg(F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.corr(actual, predicted).alias("correlation"))


def retrieval_quality(ranked: DataFrame, catalogue: DataFrame, users: DataFrame) -> DataFrame:
    """Candidates per user, mean score, distinct items and their share of the catalogue."""
    n_users = users.agg(F.count(F.lit(1)).alias("n")).scalar()
    n_items = catalogue.agg(F.count(F.lit(1)).alias("n")).scalar()
    return ranked.agg(
        (F.count(F.lit(1)) / n_users).alias("avg_candidates"), F.avg("score").alias("avg_score"),
        F.countDistinct("product_id").alias("coverage"),
    ).withColumn("diversity", F.col("coverage") / n_items)


def user_quality(ranked: DataFrame, interactions: DataFrame, k: int = 10) -> DataFrame:
    """Distinct share of each list and the part the user already knows."""
    known = interactions.select("user_id", "product_id").distinct()
    shared = overlap(ranked.select("user_id", "product_id").distinct(), known, "user_id", "product_id")
    return shared.select("user_id", (F.col("length") / F.lit(k)).alias("diversity"), "common", F.col("share").alias("relevance"))


def compare_lists(first: DataFrame, second: DataFrame, users: DataFrame, products: DataFrame) -> DataFrame:
    """Two lists per user: overlap, preferred-category hits, mean price and rating, and the verdicts on the differences."""
    wanted = users.select("user_id", "preference_category")
    parts = []
    for name, ranked in (("first", first), ("second", second)):
        stats = list_statistics(ranked, products).select(
            "user_id", F.col("avg_price").alias(f"{name}_price"), F.col("avg_rating").alias(f"{name}_rating")
        )
        hits = ranked.join(products.select("product_id", "category"), "product_id").join(wanted, "user_id").groupBy("user_id").agg(
            F.count_if(F.col("category") == F.col("preference_category")).alias(f"{name}_hits")
        )
        parts.append(stats.join(hits, "user_id"))
    shared = overlap(first, second, "user_id", "product_id").select("user_id", (F.col("share") * 100).alias("overlap_pct"))
    price, rating = F.col("second_price") - F.col("first_price"), F.col("second_rating") - F.col("first_rating")
    hits = F.col("second_hits") - F.col("first_hits")
    return shared.join(parts[0], "user_id").join(parts[1], "user_id").withColumns(
        {
            "preference": F.when(hits > 0, "improved").when(hits < 0, "reduced").otherwise("same"),
            "price": F.when(price > 50, "higher").when(price < -50, "lower").otherwise("similar"),
            "quality": F.when(rating > 0.1, "improved").when(rating < -0.1, "reduced").otherwise("similar"),
        }
    )


def metric_differences(runs: DataFrame, first: str, second: str) -> DataFrame:
    """(run, metric, value) of two runs: the metrics both have, and second minus first."""
    a, b = runs.where(F.col("run") == first), runs.where(F.col("run") == second)
    return align(a, b, ["metric"], {"value": "value"}).where(F.col("value_change").isNotNull())


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Precision, recall and NDCG at k per user; ``relevant`` holds distinct (user_id, product_id)."""
    marked = ranked.where(F.col("rank") <= k).join(relevant.select("user_id", "product_id", F.lit(1).alias("hit")), ["user_id", "product_id"], "left")
    gained = marked.groupBy("user_id").agg(
        F.count("hit").alias("hits"), F.sum(F.when(F.col("hit") == 1, F.lit(1.0) / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg")
    )
    totals = relevant.groupBy("user_id").agg(F.count(F.lit(1)).alias("relevant"))
    best = F.least(F.col("relevant"), F.lit(k)).cast("int")
    ideal = F.aggregate(F.sequence(F.lit(1), best), F.lit(0.0), lambda a, i: a + F.lit(1.0) / F.log2(i + 1))
    return gained.join(totals, "user_id").select(
        "user_id", (F.col("hits") / F.lit(k)).alias("precision"), (F.col("hits") / F.col("relevant")).alias("recall"),
        (F.col("dcg") / ideal).alias("ndcg"),
    )
