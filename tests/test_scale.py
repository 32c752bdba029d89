"""What bounds disk, memory and time on large tables: entries computed once, files that go, work in blocks."""

import glob
import os
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplens.functions import blocks
from shoplens.operators import alternating as A
from shoplens.operators import factors as M
from shoplens.operators import pairfeatures as P
from shoplens.operators import ranker
from shoplens.plans.pairs import pair_features
from shoplens.session import shared_folder
from shoplens.sources.tables import Shop


def plain_losses(rows, penalties, sweeps):
    """The training of the bias terms entry by entry; a null id leaves with its side's first fit."""
    mean = np.mean([v for *_, v in rows])
    out = {(run, 0): np.mean([(v - mean) ** 2 for *_, v in rows]) for run in penalties}
    for run, penalty in penalties.items():
        bias, kept = [{}, {}], rows
        for step in range(sweeps):
            key = step % 2
            left = defaultdict(list)
            for r in kept:
                left[r[key]].append(r[2] - mean - bias[1 - key].get(r[1 - key], 0.0))
            bias[key] = {k: sum(e) / (len(e) + penalty) for k, e in left.items()}
            kept = [r for r in kept if r[key] is not None]
            out[run, step + 1] = np.mean([(v - mean - bias[0].get(u, 0.0) - bias[1].get(i, 0.0)) ** 2 for u, i, v in kept])
    return out


def test_bias_training_reads_its_matrix_once_and_leaves_nothing(spark):
    rng = np.random.default_rng(3)
    rows = [(None if u == 7 else u, None if i == 5 else i, float(rng.integers(1, 6))) for u in range(12) for i in range(9) if (u * i) % 4]
    seen = spark.sparkContext.accumulator(0)

    def count(value):
        seen.add(1)
        return value

    matrix = spark.createDataFrame(rows, "user_id long, product_id long, value double")
    matrix = matrix.groupBy("user_id", "product_id").agg(F.sum(F.udf(count, "double")("value")).alias("value"))
    before = set(os.listdir(shared_folder(spark).removeprefix("file://")))
    penalties = {"free": 0.0, "stiff": 3.0}
    found = {(r.run, r.step): r.loss for r in M.bias_losses(matrix, penalties, 5).collect()}
    assert found == pytest.approx(plain_losses(rows, penalties, 5), abs=1e-9)
    assert seen.value == len(rows)
    assert not [f for f in set(os.listdir(shared_folder(spark).removeprefix("file://"))) - before if f.startswith(("ratings", "biases"))]


def test_shuffle_files_go_with_their_query(spark, small):
    shop = Shop(spark, small)
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    count = lambda: sum(len(glob.glob(f"{d}/*/shuffle_*.data")) for d in folders)
    before = count()
    assert M.rating_matrix(shop.interactions).agg(F.count("*")).first()[0] > 0
    assert count() <= before


def plain_als(rows, n_users, n_items, rank, iterations, penalty, seed):
    """Normal equations row by row, from the same start."""
    users, items = A._random(np.arange(n_users, dtype=np.uint64), rank, seed).astype(float), np.zeros((n_items, rank))
    for _ in range(iterations):
        for mine, theirs, own, other in ((items, users, 1, 0), (users, items, 0, 1)):
            for row in range(len(mine)):
                some = [r for r in rows if r[own] == row]
                a, b = theirs[[r[other] for r in some]], np.array([r[2] for r in some])
                mine[row] = np.linalg.solve(a.T @ a + penalty * len(some) * np.eye(rank), a.T @ b).astype(np.float32)
    return users, items


def test_blocked_factors_solve_the_normal_equations(spark, monkeypatch):
    """Rows with fewer ratings than the rank, with more, and with many, over several blocks; each block gets only rows it needs."""
    rng = np.random.default_rng(8)
    rows = [(u, i, float(np.float32(rng.normal()))) for u in range(23) for i in range(17) if i == 3 or u == 4 or (u * 7 + i * 5) % 11 < 3]
    residual = spark.createDataFrame(rows, "user_no int, item_no int, residual double")
    monkeypatch.setattr(A, "FACTOR_BYTES", 4 * 6 * 8)
    monkeypatch.setattr(A, "CHUNK", 60)
    numbers = []
    monkeypatch.setattr(A, "block_number", lambda *a, f=A.block_number: numbers.append(f(*a)) or numbers[-1])
    found = A.alternate(residual, len(rows), 23, 17, 6, 3, 0.1, 5)
    users, items = plain_als(rows, 23, 17, 6, 3, 0.1, 5)
    assert min(numbers) > 1
    for df, plain in ((found.userFactors, users), (found.itemFactors, items)):
        got = {r.id: r.features for r in df.collect()}
        assert sorted(got) == list(range(len(plain)))
        assert np.allclose([got[n] for n in range(len(plain))], plain, atol=1e-4)
    error = found.errors.agg(F.sum("squares"), F.sum("ratings")).first()
    assert error[1] == len(rows) and error[0] == pytest.approx(sum((v - users[u] @ items[i]) ** 2 for u, i, v in rows), abs=1e-3)


def test_blocks_follow_memory_and_large_ranks_are_solved_in_blocks(spark, small):
    assert A.block_number(600_000, 20_000, 100, 8) == 8  # all factors fit: as many as run at once
    for ratings, others, rank in ((36_000_000, 1_200_000, 100), (216_000_000, 7_200_000, 50)):
        number = A.block_number(ratings, others, rank, 12)
        met = others * (1 - np.exp(-ratings / number / others))
        assert number % 12 == 0 and met * rank * 4 <= A.FACTOR_BYTES
    centred = M.centre(M.rating_matrix(Shop(spark, small).interactions))
    model = M.train_als(centred, rank=60, iterations=2)
    assert isinstance(model, A.Factors)
    errors = M.fit_errors(centred, model).first()
    assert errors.rmse < errors.plain_rmse


def test_products_copy_rows_for_large_blocks_only(spark):
    """Half a million vectors were copied to 245 blocks on either side, and each block kept k rows per vector."""
    rows = spark.range(500_000)
    slots = spark.sparkContext.defaultParallelism
    assert blocks.grid(rows, rows, blocks.LEFT_ROWS) == (max(31, slots), 1)
    few = spark.range(300)
    n, chunks = blocks.grid(few, rows, blocks.LEFT_ROWS)
    assert n * chunks >= slots and n <= 3


def test_best_rows_over_many_tiles_with_ties_and_repeated_ids(spark):
    rng = np.random.default_rng(4)
    right = [(int(i) // 2, [float(x) for x in rng.integers(0, 3, 4)]) for i in range(4500)]
    left = [(i, [float(x) for x in rng.integers(0, 3, 4)]) for i in (1, 2, 2, 9, 40)] + [(7, [0.0] * 4)]
    schema = "id long, vector array<double>"
    skip = spark.createDataFrame([(1, 5), (1, 2000), (2, 17), (2, None), (3, 4)], "id long, other long")
    got = defaultdict(list)
    for r in blocks.best_matches(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 7, skip=skip, skip_self=True).collect():
        got[r.id].append((r["rank"], -r.score, r.other))
    not_wanted = {(1, 5), (1, 2000), (2, 17)}
    for key in {i for i, _ in left}:
        scored = sorted((-float(np.dot(a, b)), j) for i, a in left if i == key for j, b in right if j != i and (i, j) not in not_wanted)
        assert sorted(got[key]) == [(n + 1, *pair) for n, pair in enumerate(scored[:7])]


def test_vectors_that_are_missing_or_of_another_length_are_refused(spark):
    for bad in (None, [1.0]):
        df = spark.createDataFrame([(1, [1.0, 0.0]), (2, bad)], "id long, vector array<double>")
        with pytest.raises(Exception, match="one length"):
            blocks.best_matches(df, df, 1).collect()


def test_negatives_keep_their_draws_only_and_cut_by_number(spark, small):
    interactions = Shop(spark, small).interactions
    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    found = P.negatives(interactions)
    assert [f for f in (f.split("-")[0] for f in set(os.listdir(folder)) - before) if f in ("pairs", "draws")] == ["draws"]
    assert found.count() == 2 * interactions.count() and "Window" not in found._jdf.queryExecution().executedPlan().toString()
    numbers = [3, 9, 10, 11, 4000, 5000, 5001, 9999]
    df = spark.createDataFrame([(n,) for n in reversed(numbers)], "draw long")
    for wanted in range(9):
        assert sorted(r.draw for r in P._first(df, "draw", wanted, 10_000).collect()) == numbers[:wanted]


def test_pairs_are_joined_once_per_side(spark, small):
    """Every join of the pairs shuffles all of them with the features they carry so far; there were four."""
    pairs = spark.range(123).select(F.col("id").alias("user_id"), F.col("id").alias("product_id"))
    plan = pair_features(Shop(spark, small), pairs)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    indent = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(i for i, line in enumerate(plan) if "Range (0, 123" in line)
    depth, joins = indent(plan[at]), 0
    for line in reversed(plan[:at]):
        if indent(line) < depth:
            depth, joins = indent(line), joins + ("Join LeftOuter" in line)
    assert joins == 2


def test_stored_samples_are_read_where_they_are(spark, small, tmp_path):
    shop, written = Shop(spark, small), []
    table = pair_features(shop, P.training_samples(shop.interactions))
    table.write.parquet(str(tmp_path / "t"))
    stored, kept = spark.read.parquet(str(tmp_path / "t")), type(table).checkpoint
    type(table).checkpoint = lambda self, *a: written.append(1) or kept(self, *a)
    try:
        model = ranker.train(stored, trees=2, depth=3, stored=True)
    finally:
        type(table).checkpoint = kept
    assert not written and model.getNumTrees >= 1
