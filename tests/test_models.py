from pyspark.sql import functions as F

from shoplens.functions.scalars import dot
from shoplens.operators import factors as M
from shoplens.operators import pairfeatures as P
from shoplens.operators import ranker
from shoplens.operators import recommend as R
from shoplens.operators import similarity as S
from shoplens.plans import models
from shoplens.plans.pairs import pair_features
from shoplens.sources.tables import Shop


def fit_error(matrix, iterations):
    users, items, mean = M.fit_als(matrix, rank=8, iterations=iterations)
    centre = mean.scalar()
    guess = centre + F.col("user_bias") + F.col("item_bias") + dot(F.col("user_vector"), F.col("item_vector"))
    return matrix.join(users, "user_id").join(items, "product_id").agg(F.avg(F.pow(F.col("value") - guess, F.lit(2.0))).alias("e")).first().e


def test_more_iterations_fit_better(spark, small):
    matrix = M.rating_matrix(Shop(spark, small).interactions)
    assert fit_error(matrix, 6) < fit_error(matrix, 1)


def test_negatives_are_twice_the_positives_and_disjoint(spark, small):
    interactions = Shop(spark, small).interactions
    found = P.negatives(interactions)
    assert found.count() == 2 * interactions.count()
    assert found.join(interactions, ["user_id", "product_id"], "left_semi").count() == 0


def test_negatives_do_not_depend_on_the_partitioning(spark, small):
    interactions = Shop(spark, small).interactions
    first = sorted(P.negatives(interactions.repartition(3)).collect())
    assert first == sorted(P.negatives(interactions.repartition(11)).collect())


def test_ranker_learns_and_orders_features(spark, small):
    shop = Shop(spark, small)
    table = pair_features(shop, P.training_samples(shop.interactions))
    model = ranker.train(table, trees=3, depth=3)
    scored = ranker.score(model, table)
    spread = scored.agg(F.avg(F.pow(F.col("rating") - F.col("prediction"), F.lit(2.0))).alias("e"), F.var_pop("rating").alias("v")).first()
    assert spread.e < spread.v
    ranks = [r.importance for r in ranker.importances(spark, model).collect()]
    assert len(ranks) == len(P.FEATURES) and ranks == sorted(ranks, reverse=True)


def test_queries_train_the_declared_ranker():
    assert (models.TREES, models.DEPTH) == (ranker.TREES, ranker.DEPTH) == (200, 7)


def test_recommendations_are_unseen_and_sorted(spark, small):
    shop = Shop(spark, small)
    ranked = R.personal(shop.user_factors, shop.item_factors, 10, shop.interactions)
    assert ranked.join(shop.interactions, ["user_id", "product_id"], "left_semi").count() == 0
    for rows in ranked.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("l")).collect():
        scores = [e.score for e in rows.l]
        assert len(scores) == 10 and scores == sorted(scores, reverse=True)


def test_hybrid_equals_the_full_matrix(spark):
    vectors = [(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0]), (4, [-1.0, 0.2])]
    df = spark.createDataFrame(vectors, "id long, vector array<double>")
    shared = spark.createDataFrame([(1, 4, 0.5), (4, 1, 0.5), (2, 3, 0.25), (3, 2, 0.25)], "item_id long, other_id long, score double")
    import numpy as np

    v = {i: np.array(x) for i, x in vectors}
    cos = {(i, j): round(float(v[i] @ v[j] / np.linalg.norm(v[i]) / np.linalg.norm(v[j])), 6) for i in v for j in v if i != j}
    low, high = min(cos.values()), max(cos.values())
    pairs = {(r.item_id, r.other_id): r.score for r in shared.collect()}
    full = {k: round(0.7 * (c - low) / (high - low) + 0.3 * pairs.get(k, 0.0) / 0.5, 6) for k, c in cos.items()}
    for k in (1, 2, 3):
        got = {(r.item_id, r.other_id): r.score for r in S.hybrid(df, shared, k).collect()}
        best = {p for i in v for p in sorted((p for p in full if p[0] == i), key=lambda p: (-full[p], p[1]))[:k]}
        assert set(got) == best and all(abs(got[p] - full[p]) < 1e-6 for p in got)


def test_cold_start_falls_back_to_the_whole_shop(spark):
    users = spark.createDataFrame([(1, "A"), (2, None), (3, "A")], "user_id long, preference_category string")
    products = spark.createDataFrame([(10, "A"), (11, "A"), (12, "B")], "product_id long, category string")
    rows = [(3, 10, "view", "2024-01-01"), (3, 11, "purchase", "2024-01-01"), (3, 12, "purchase", "2024-01-31")]
    interactions = spark.createDataFrame(rows, "user_id long, product_id long, interaction_type string, ts string").withColumn("ts", F.to_timestamp("ts"))
    now = F.lit("2024-01-31").cast("timestamp")
    got = R.cold_start(users, interactions, products, now, k=2).collect()
    lists = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        lists.setdefault(r.user_id, []).append(r.product_id)
    assert lists == {1: [11, 10], 2: [12, 11]}


def test_the_trainer_keeps_one_iteration_of_shuffle_files(spark, small, monkeypatch):
    import pyspark.ml.recommendation as R

    intervals, fit = [], R.ALS.fit
    monkeypatch.setattr(R.ALS, "fit", lambda self, df: intervals.append(self.getCheckpointInterval()) or fit(self, df))
    centred = M.centre(M.rating_matrix(Shop(spark, small).interactions))
    M.train_als(centred, rank=2, iterations=2)
    assert intervals == [1]
    for df in (centred.residual, centred.users, centred.items, centred.mean):  # the tables are not read again
        assert "parquet" not in df._jdf.queryExecution().toString()


def test_training_partitions_are_bounded(spark, small, monkeypatch):
    """Files of many alike rows are small, and were packed into one task whatever their rows."""
    monkeypatch.setattr(models, "TASK_ROWS", 500)
    monkeypatch.setattr(models, "_KEPT", {})
    shop = Shop(spark, small)
    rows = models.training_table(shop, models.file_by_file(spark)).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in rows) <= 500 and sum(r["count"] for r in rows) == 3 * shop.interactions.count()
