"""Hard-negative mining against plain Python, the curve's neighbourhood, and how few blocks are read."""

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from shoplens.llm import negatives, topk
from shoplens.llm.common import Tables


def brute(rows):
    usable = set()
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.add((i, tuple(math.floor(256 * x) for x in v), label))
    anchors = {}
    for i, v, label in usable:
        if i % 50 == 0:
            anchors[i] = min((v, label), anchors.get(i, (v, label)))
    out = []
    for a, (v, label) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, w, other in usable if i != a)
        for score, positive, _ in [s for s in scored if s[2] == label][:5]:
            inside = [(-s, i) for s, i, other in scored if other != label and 50 * -score <= 100 * -s <= 95 * -score]
            out += [(a, positive, rank, i, -score, s) for rank, (s, i) in enumerate(inside[:3], 1)]
    return sorted(out)


def vectors_of(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return table.select(F.col("vec_id").alias("id"), topk.whole_numbers("embedding").alias("numbers"), "label", F.lit(1).alias("score"), F.lit("x").alias("block"))


def clustered(n, spread=0.2, dims=8, centres=6):
    draw = np.random.default_rng(4)
    middle = draw.normal(size=(centres, dims))
    return [(i, [float(x) for x in middle[i % centres] + spread * draw.normal(size=dims)], int(draw.integers(4))) for i in range(n)]


def mined(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, df.collect()))


def test_as_brute_force_with_ties_and_odd_vectors(spark):
    rows = clustered(700)
    rows += [(1000 + i, rows[50][1], i % 3) for i in range(90)]  # a common vector, so ties
    rows += [(2000, None, 1), (2050, [1.0, None], 1), (2100, [float("nan")] * 8, 1), (2150, [float("inf")] * 8, 1), (2200, [], 1), (2250, [0.5], 2), (None, [1.0] * 8, 1), (2300, [0.4] * 8, None)]
    rows += [rows[0], rows[100], (150, [9.0] * 8, 1), (2350, [1e7] * 8, 0), (3, [-2e7] * 8, 1), (2400, [0.0] * 8, 2)]
    vectors = vectors_of(spark, rows)
    for sizes in ({"block_rows": 32, "chunk_anchors": 4, "chunk_zones": 3}, {}):
        assert mined(negatives.mine(vectors, vectors.where("id % 50 = 0"), Tables("test"), **sizes)) == brute(rows)
    assert mined(negatives.mine(vectors.limit(0), vectors.limit(0), Tables("test"))) == []
    alone = vectors.where("id = 50")
    assert mined(negatives.mine(alone, alone, Tables("test"))) == []


def test_one_id_and_one_vector_with_many_rows(spark):
    """Equal rows count once; rows of one id or of one vector fill several blocks."""
    few = [(i, [float(i % 7 + 1), float(i % 5 + 1)], i // 10 % 3) for i in range(0, 400, 10)]
    for more in ([(50, [3.0, 1.0], 1)] * 3000, [(50, [3.0, x / 16], 1) for x in range(1, 400)], [(1000 + i, [2.0, 2.0], i % 2) for i in range(500)]):
        vectors = vectors_of(spark, few + more)
        assert mined(negatives.mine(vectors, vectors.where("id % 50 = 0"), Tables("test"), block_rows=64)) == brute(few + more)


def test_neighbours_on_the_curve_are_neighbours_in_space():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        position = negatives.hilbert_positions(cells, bits)
        assert sorted(position) == list(range(len(cells)))
        along = cells[np.argsort(position)]
        assert (np.abs(np.diff(along, axis=0)).sum(1) == 1).all()


def test_intervals_enclose_every_score():
    draw = np.random.default_rng(1)
    values, vectors = draw.integers(-300, 300, (200, 5)), draw.integers(-300, 300, (20, 5))
    low, high = values.min(0)[None, :], values.max(0)[None, :]
    least, most = negatives.intervals(vectors, low, high)
    scores = vectors @ values.T
    assert (scores.min(1) >= least[:, 0]).all() and (scores.max(1) <= most[:, 0]).all()


def test_windows_in_whole_numbers():
    for score in (*range(-40, 200), 10**17 + 3):
        low, high = negatives.window(score)
        inside = lambda n: 50 * score <= 100 * n <= 95 * score
        assert low > high or (inside(low) and inside(high))
        assert not inside(low - 1) and not inside(high + 1)


def test_zone_maps_spare_blocks(spark):
    """On clustered vectors anchors ask for a part of the blocks; every row is in exactly one block."""
    rows = clustered(4000, spread=0.05, centres=40)
    vectors = vectors_of(spark, rows)
    miner = negatives.Miner(vectors, vectors.where("id % 50 = 0"), Tables("test"), block_rows=50)
    held = miner.blocks.select("ids").collect()
    ids = [i for r in held for i in np.frombuffer(r.ids, np.int64).tolist()]
    assert sorted(ids) == list(range(4000)) and len(held) >= 80
    empty = F.lit(None).cast("bigint")
    home = miner.against_zones(miner.anchors, negatives.best_blocks, "id bigint, kind string, reach double, block bigint").where("kind = 'own'").groupBy("id").agg(F.max("reach").alias("reach"))
    asked = miner.anchors.join(home, "id").withColumn("floor", (F.col("reach") * 0.6).cast("bigint")).withColumn("first", empty).withColumn("salt", F.lit(0).cast("bigint"))
    visits = miner.against_zones(asked.withColumn("wins", F.lit(None).cast(negatives.ASKED.split("wins ")[1])), negatives.blocks_for_positives, negatives.ASKED)
    assert visits.count() < 0.5 * len(held) * miner.anchors.count()
