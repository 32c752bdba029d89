import random
import statistics

from pyspark.sql import functions as F

from shoplens.functions.ordered import framed, assign_ranges, carry_forward, dense_index, exact_quantiles, running


def rows_with_hot_group(n=600):
    random.seed(5)
    return [("hot" if i % 3 == 0 else f"g{i % 17}", i, random.randint(0, 40)) for i in range(n)]


def test_running_sum_matches_a_plain_loop_for_any_partitioning(spark):
    rows = rows_with_hot_group()
    expected, sums = {}, {}
    for g, i, v in sorted(rows):
        sums[g] = sums.get(g, 0) + v
        expected[g, i] = sums[g]
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "g string, i long, v long").repartition(parts)
        got = running(df, ["i"], {"upto": F.col("v")}, by=["g"], totals=True, ranges=8).collect()
        assert {(r.g, r.i): r.upto for r in got} == expected
        assert all(r.upto_total == sums[r.g] for r in got)


def test_a_hot_group_is_spread_over_ranges(spark):
    df = spark.createDataFrame(rows_with_hot_group(), "g string, i long, v long")
    spans = assign_ranges(df, ["g", "i"], 32).where("g = 'hot'").select("_range").distinct().count()
    assert spans >= 5


def test_range_numbers_follow_the_key_order(spark):
    df = spark.createDataFrame(rows_with_hot_group(), "g string, i long, v long")
    placed = [(r.g, r.i, r._range) for r in assign_ranges(df, ["g", "i"], 16).collect()]
    numbers = [p[2] for p in sorted(placed)]
    assert numbers == sorted(numbers) and max(numbers) == 15


def test_timestamps_as_range_keys(spark):
    df = spark.range(200).select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts"), "id")
    got = running(df, ["ts"], {"n": F.lit(1)}, ranges=8).collect()
    assert all(r.n == r.id + 1 for r in got)


def test_dense_index_is_sorted_and_skips_null(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), (None,), ("z",)], "k string")
    assert {r.k: r.i for r in dense_index(df, "k", "i").collect()} == {"a": 0, "b": 1, "z": 2}


def test_exact_quantiles_by_group(spark):
    rows = rows_with_hot_group()
    df = spark.createDataFrame(rows, "g string, i long, v long")
    got = {r.g: r for r in exact_quantiles(df, "v", {"m": 0.5, "q": 0.25}, by=["g"]).collect()}
    for g in {r[0] for r in rows}:
        values = sorted(v for name, _, v in rows if name == g)
        assert got[g].m == statistics.median(values)
        at = 0.25 * (len(values) - 1)
        low = values[int(at)]
        high = values[min(int(at) + 1, len(values) - 1)]
        assert abs(got[g].q - (low + (high - low) * (at - int(at)))) < 1e-9


def test_nearest_rank_uses_floor_of_q_times_n(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    row = exact_quantiles(df, "v", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, nearest=True).first()
    assert (row.p50, row.p90, row.p99) == (5.0, 9.0, 10.0)


def test_constant_column_and_single_value(spark):
    df = spark.createDataFrame([(7.0,)] * 5, "v double")
    assert exact_quantiles(df, "v", {"m": 0.5}).first().m == 7.0


def test_carry_forward_across_ranges(spark):
    rows = [("a", i, i if i % 50 == 10 else None) for i in range(300)] + [("b", i, None) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    got = {(r.g, r.i): r.last for r in carry_forward(df, ["g"], ["i"], "v", "last", ranges=16).collect()}
    last = None
    for i in range(300):
        last = i if i % 50 == 10 else last
        assert got["a", i] == last
    assert all(got["b", i] is None for i in range(20))


def test_many_ranges_are_bisected_like_few(spark):
    df = spark.createDataFrame(rows_with_hot_group(), "g string, i long, v long")
    got = [(r.g, r.i, r._range) for r in assign_ranges(df, ["g", "i"], 200).collect()]
    numbers = [p[2] for p in sorted(got)]
    assert numbers == sorted(numbers) and max(numbers) == 199
    sums = {(r.g, r.i): r.upto for r in running(df, ["i"], {"upto": F.col("v")}, by=["g"], ranges=200).collect()}
    assert sums == {(r.g, r.i): r.upto for r in running(df, ["i"], {"upto": F.col("v")}, by=["g"], ranges=5).collect()}


def test_frames_cross_the_borders_of_pieces(spark):
    values = [(i, float((i * 37) % 11)) for i in range(500)]
    df = spark.createDataFrame(values, "t long, v double").repartition(7)
    for before, piece in ((3, 3), (24, 50), (7, 1000)):
        got = framed(df, ["t"], before, {"m": lambda w: F.avg("v").over(w), "n": lambda w: F.count("v").over(w)}, piece=piece)
        assert got.columns == ["t", "v", "m", "n"]
        rows = {r.t: (r.m, r.n) for r in got.collect()}
        assert len(rows) == 500
        for t, _ in values:
            frame = [v for _, v in values[max(0, t - before):t]]
            assert rows[t][1] == len(frame) and (not frame and rows[t][0] is None or abs(rows[t][0] - sum(frame) / len(frame)) < 1e-9)
    assert framed(df.limit(0), ["t"], 2, {"m": lambda w: F.avg("v").over(w)}).collect() == []
