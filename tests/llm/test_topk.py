import math

import numpy as np
from pyspark.sql import functions as F

from shoplens.llm import topk
from shoplens.llm.common import Tables


def brute(rows, k):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.setdefault((i, tuple(math.floor(256 * x) for x in v)))
    queries = {}
    for i, v in usable:
        if i % 50 == 0:
            queries[i] = min(v, queries.get(i, v))
    out = []
    for q, v in queries.items():
        scores = sorted((-min(sum(a * b for a, b in zip(v, w)), 2**63 - 1), i) for i, w in usable if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_as_brute_force_with_ties_and_odd_vectors(spark):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + 0.2 * draw.normal(size=8)]) for i in range(700)]
    rows += [(1000 + i, rows[50][1]) for i in range(90)]  # a common vector, so ties
    rows += [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, []), (2250, [0.5]), (None, [1.0] * 8)]
    rows += [rows[0], rows[100], (150, [9.0] * 8), (2300, [1e9] * 8), (3, [2e9] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = table.select(F.col("vec_id").alias("id"), topk.whole_numbers("embedding").alias("numbers"), F.lit(1).alias("score"))
    for shard_rows, sample in ((64, 256), (4096, 4096)):
        found = topk.top_k(vectors, vectors.where("id % 50 = 0"), Tables("test"), shard_rows=shard_rows, sample=sample)
        assert sorted(map(tuple, found.collect())) == brute(rows, 5)
    few = vectors.where("id < 3")
    assert sorted(map(tuple, topk.top_k(few, few.where("id = 0"), Tables("test")).collect())) == brute([r for r in rows if r[0] is not None and r[0] < 3], 5)
    assert topk.top_k(vectors.limit(0), vectors.limit(0), Tables("test")).collect() == []


def test_one_id_with_many_rows(spark):
    """Equal rows count once before shards are counted, and unequal rows of one id are spread over the shards."""
    few = [(i, [float(i % 7), float(i % 5)]) for i in range(0, 120, 10)]
    for rows in (few + [(50, [3.0, 1.0])] * 5000, few + [(50, [3.0, x / 16]) for x in range(3000)]):
        vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select(F.col("vec_id").alias("id"), topk.whole_numbers("embedding").alias("numbers"))
        found = topk.top_k(vectors, vectors.where("id % 50 = 0"), Tables("test"), shard_rows=500)
        assert sorted(map(tuple, found.collect())) == brute(rows, 5)


def test_queries_in_several_turns(spark, monkeypatch):
    monkeypatch.setattr(topk, "TURN_QUERIES", 2)
    monkeypatch.setattr(topk, "BLOCK", 2)
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.normal(size=4)]) for i in range(600)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select(F.col("vec_id").alias("id"), topk.whole_numbers("embedding").alias("numbers"))
    found = topk.top_k(vectors, vectors.where("id % 50 = 0"), Tables("test"), shard_rows=60, sample=256)
    assert sorted(map(tuple, found.collect())) == brute(rows, 5)
