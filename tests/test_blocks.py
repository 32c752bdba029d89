import itertools
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from shoplens.functions import blocks
from shoplens.functions.blocks import best_matches, listed_pairs, pair_counts, salted, score_totals, with_sizes
from shoplens.operators.similarity import InvertedLists, matches_in_cells, nearest, recall


def vectors(spark, n, seed, base=0):
    rng = np.random.default_rng(seed)
    data = {base + i: rng.normal(size=6) for i in range(n)}
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in data.items()], "id long, vector array<double>"), data


def brute(left, right, k, skip=frozenset(), cosine=False):
    out = {}
    for i, a in left.items():
        scored = []
        for j, b in right.items():
            if (i, j) in skip:
                continue
            s = float(a @ b)
            if cosine:
                s /= float(np.linalg.norm(a) * np.linalg.norm(b))
            scored.append((-round(s, 6), j))
        out[i] = [j for _, j in sorted(scored)[:k]]
    return out


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.id, r.rank)):
        out.setdefault(r.id, []).append(r.other)
    return out


def test_best_matches_equals_brute_force_whatever_the_block_size(spark):
    left, a = vectors(spark, 13, 1)
    right, b = vectors(spark, 29, 2, 100)
    for size in (4, 1000):
        assert listed(best_matches(left, right, 5, block_rows=size)) == brute(a, b, 5)


def test_skipped_pairs_do_not_come_back(spark):
    left, a = vectors(spark, 7, 3)
    right, b = vectors(spark, 11, 4, 100)
    skip = {(i, j) for i in a for j in b if (i + j) % 3 == 0}
    pairs = spark.createDataFrame(sorted(skip) + [(999, 100)], "id long, other long")
    assert listed(best_matches(left, right, 4, skip=pairs, block_rows=3)) == brute(a, b, 4, skip)


def test_orthogonal_parallel_opposite_and_zero_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0]), (5, [0.0, 0.0])], "id long, vector array<double>")
    got = {(r.id, r.other): r.score for r in best_matches(df, df, 10, cosine=True, skip_self=True, block_rows=2).collect()}
    assert got[1, 2] == 1.0 and got[1, 3] == 0.0 and got[1, 4] == -1.0 and got[1, 5] == 0.0
    assert (1, 1) not in got and len(got) == 20


def test_score_totals(spark):
    df, data = vectors(spark, 9, 5)
    got = {r.id: r for r in score_totals(df, df, cosine=True, skip_self=True, block_rows=4).collect()}
    for i, a in data.items():
        cos = [round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6) for j, b in data.items() if j != i]
        assert got[i].pairs == 8 and abs(got[i].total - sum(cos)) < 1e-9 and got[i].high == max(cos) and got[i].low == min(cos)


def baskets(spark):
    random.seed(9)
    rows = {(u, i) for u in range(40) for i in random.sample(range(30), random.randint(1, 6))}
    rows |= {(99, i) for i in range(30)}  # one basket with every item
    return rows, spark.createDataFrame(sorted(rows), "basket long, item long")


def count_pairs(rows, keep=lambda n: True):
    by = {}
    for u, i in rows:
        by.setdefault(u, set()).add(i)
    return Counter(p for items in by.values() if keep(len(items)) for p in itertools.combinations(sorted(items), 2))


def test_pair_counts_are_exact_for_large_baskets(spark):
    rows, df = baskets(spark)
    expected = count_pairs(rows)
    for light, size in ((3, 7), (50, 7), (2, 1000)):
        got = {(r.a, r.b): r.together for r in pair_counts(df, "basket", "item", light=light, block_rows=size).collect()}
        assert got == expected


def test_listed_pairs_ignore_baskets_outside_the_size_range(spark):
    rows, df = baskets(spark)
    got = {(r.a, r.b): r.together for r in listed_pairs(with_sizes(df, "basket", "item"), "basket", "item", largest=5, smallest=3).collect()}
    assert got == count_pairs(rows, lambda n: 3 <= n <= 5)


def test_cells_are_split_and_searched_exactly(spark):
    left, a = vectors(spark, 8, 6)
    right, b = vectors(spark, 20, 7, 100)
    half = F.pmod("id", F.lit(2)).cast("int")
    got = listed(matches_in_cells(left.withColumn("cell", half), right.withColumn("cell", half), 3, block_rows=4))
    for i, found in got.items():
        assert found == brute({i: a[i]}, {j: v for j, v in b.items() if j % 2 == i % 2}, 3)[i]


def test_searching_every_list_finds_every_neighbour(spark):
    queries, _ = vectors(spark, 5, 8)
    items, _ = vectors(spark, 60, 9, 100)
    lists = InvertedLists(items, cells=4)
    exact = nearest(queries, items, 5)
    assert recall(exact, lists.search(queries, 5, probes=4)).first().recall == 1.0
    assert 0.2 < recall(exact, lists.search(queries, 5, probes=2)).first().recall <= 1.0


def test_a_basket_with_a_third_of_the_rows_is_dealt_out(spark):
    """No (basket, salt) holds more than two hundredths of the rows, and sizes and pair counts are those of plain Python."""
    rows = [(0, i) for i in range(1000)] + [(1 + i // 20, (i * 7) % 900) for i in range(2000)]
    rows = sorted(set(rows))
    df = spark.createDataFrame(rows, "basket long, item long")
    sizes = df.groupBy("basket").agg(F.count(F.lit(1)).alias("basket_size"))
    groups = salted(df, sizes, "basket", "item", rows=32).groupBy("basket", "_salt").count().collect()
    assert max(r["count"] for r in groups) <= 0.02 * len(rows)
    counts = Counter(b for b, _ in rows)
    found = with_sizes(df, "basket", "item", smallest=2, rows=32).collect()
    assert sorted((r.basket, r.item, r.basket_size) for r in found) == sorted((b, i, counts[b]) for b, i in rows if counts[b] >= 2)


def test_heavy_pairs_of_a_salted_basket_and_of_text_items(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SALT_ROWS", 8)
    rng = random.Random(2)
    rows = sorted({(b, f"i{rng.randrange(60):02d}") for b in range(6) for _ in range(55)})
    df = spark.createDataFrame(rows, "basket long, item string")
    wanted = Counter()
    for basket in range(6):
        wanted.update(itertools.combinations(sorted(i for b, i in rows if b == basket), 2))
    got = {(r.a, r.b): r.together for r in pair_counts(df, "basket", "item", light=5, block_rows=16).collect()}
    assert got == dict(wanted)
    nothing = pair_counts(df.limit(0), "basket", "item")
    assert nothing.collect() == [] and nothing.schema["a"].dataType.simpleString() == "string"


def test_sparse_baskets_are_listed_and_dense_ones_multiplied(spark, monkeypatch):
    """Many items make as many cells as pairs: such baskets are listed, whatever their size, and no pair is lost either way."""
    rng = random.Random(5)
    rows = sorted({(b, rng.randrange(4000)) for b in range(12) for _ in range(70)} | {(20, i) for i in range(300)} | {(21, i) for i in range(0, 600, 2)})
    df = spark.createDataFrame(rows, "basket long, item long")
    wanted, product = count_pairs(rows), blocks._heavy_pairs
    multiplied = []
    monkeypatch.setattr(blocks, "_heavy_pairs", lambda rows, *a: multiplied.append(rows.agg(F.min("basket_size")).first()[0]) or product(rows, *a))
    for cell, least in ((blocks.CELL_PAIRS, []), (0, [50])):
        monkeypatch.setattr(blocks, "CELL_PAIRS", cell)
        got = {(r.a, r.b): r.together for r in pair_counts(df, "basket", "item", light=5, block_rows=256).collect()}
        assert got == wanted
        assert all(m >= x for m, x in zip(multiplied, least)) and len(multiplied) == len(least), (cell, multiplied)
        multiplied.clear()
