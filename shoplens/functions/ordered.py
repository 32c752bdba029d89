"""Order-dependent computations without sorting a whole table, or a hot group, in one task.

A running sum over an ordered relation is split at sampled boundaries: rows are assigned to ranges of the composite
key (group columns, order columns), each range is accumulated on its own, and the totals of the earlier ranges of
the same group, at most ``ranges`` rows per group, are added. A group with a third of all rows spans about a third
of the ranges. Dense ids, exact quantiles, ordered splits and distribution distances are built on it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

MIN_RANGES, MAX_RANGES = 64, 4096
PIECE_ROWS = 1 << 16


def _comparable(df: DataFrame, name: str) -> Column:
    """Timestamps compare as microseconds, so that boundaries survive the trip through the driver."""
    kind = df.schema[name].dataType
    return F.unix_micros(name) if isinstance(kind, T.TimestampType) else F.col(name)


def range_count(df: DataFrame) -> int:
    """As many ranges as the cluster's shuffles have partitions, within bounds the driver can hold."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(MIN_RANGES, min(MAX_RANGES, partitions))


def assign_ranges(df: DataFrame, keys: Sequence[str], ranges: int | None = None, name: str = "_range") -> DataFrame:
    """Number of sampled boundaries below each row's key. The keys must identify a row and not be null.

    The sample holds the ``ranges - 1`` rows with the smallest key hashes (a bounded top-n, the only rows that reach
    the driver), so boundaries depend on the data alone, never on the partitioning. Few boundaries become a
    comparison tree that is compiled with the rest of the stage, many a literal array that is bisected.
    """
    ranges = ranges or range_count(df)
    columns = [_comparable(df, k) for k in keys]
    names = [f"k{i}" for i in range(len(keys))]
    keyed = df.select(*[c.alias(n) for c, n in zip(columns, names)])
    sample = keyed.orderBy(F.xxhash64(*names), *names).limit(ranges - 1)
    bounds = [tuple(row) for row in sample.orderBy(*names).collect()]
    if len(bounds) < MIN_RANGES:
        return df.withColumn(name, _tree(columns, bounds))
    values = json.dumps([dict(zip(names, bound)) for bound in bounds])
    literal = F.from_json(F.lit(values), T.ArrayType(keyed.schema))
    key = F.struct(*[c.alias(n) for c, n in zip(columns, names)])
    return df.withColumn(name, _bisect(literal, len(bounds), key))


def _tree(columns: Sequence[Column], bounds: Sequence[tuple]) -> Column:
    def above(bound: tuple) -> Column:
        column, value = columns[len(columns) - len(bound)], F.lit(bound[0])
        if len(bound) == 1:
            return column > value
        return (column > value) | ((column == value) & above(bound[1:]))

    def place(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(above(bounds[middle]), place(middle + 1, high)).otherwise(place(low, middle))

    return place(0, len(bounds))


def _bisect(bounds: Column, n: int, key: Column) -> Column:
    """Steps of n/2, n/4, ..., 1, each taken if the boundary it reaches is below the key."""
    steps = F.array(*[F.lit(2**i) for i in reversed(range(n.bit_length()))])

    def step(found: Column, width: Column) -> Column:
        reached = found + width
        return F.when((reached <= n) & (F.get(bounds, reached - 1) < key), reached).otherwise(found)

    return F.coalesce(F.aggregate(steps, F.lit(0), step), F.lit(0))


def running(
    df: DataFrame,
    order: Sequence[str],
    measures: Mapping[str, Column],
    by: Sequence[str] = (),
    totals: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """Inclusive running sum of every measure, per group, in the given order.

    (by, order) must be unique; pre-aggregate repeated keys first. With ``totals`` the group's sum is added as
    ``<measure>_total``.
    """
    by, order = list(by), list(order)
    prepared = df
    for name, measure in measures.items():
        prepared = prepared.withColumn(f"_m_{name}", measure)
    ranged = assign_ranges(prepared, by + order, ranges)
    sums = ranged.groupBy(*by, "_range").agg(*[F.sum(f"_m_{n}").alias(f"_s_{n}") for n in measures])
    earlier = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    offsets = sums.select(
        *by, "_range",
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in measures],
        *([F.sum(f"_s_{n}").over(whole).alias(f"{n}_total") for n in measures] if totals else []),
    )
    inside = W.partitionBy(*by, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = ranged
    for name in measures:
        local = local.withColumn(f"_l_{name}", F.sum(f"_m_{name}").over(inside))
    joined = _same_group(local, offsets, [*by, "_range"])
    extra = [F.col(f"{n}_total") for n in measures] if totals else []
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in measures],
        *extra,
    )


def framed(df: DataFrame, order: Sequence[str], before: int, measures: Mapping[str, Callable[[WindowSpec], Column]], piece: int = PIECE_ROWS) -> DataFrame:
    """Measures over the ``before`` rows that precede each row of the whole table, without a window over all of it.

    Rows are numbered by a running count and cut into pieces of at least ``before`` rows; a piece also receives the last rows
    of the piece before it, which leave again when the frames have been computed. ``order`` must be unique.
    """
    piece = max(piece, before)
    numbered = running(df, order, {"_no": F.lit(1)}).withColumn("_at", (F.col("_no") - 1).cast("long")).drop("_no")
    own = F.expr(f"_at div {piece}")
    pieces = F.when(F.col("_at") % piece >= piece - before, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = numbered.withColumn("_piece", F.explode(pieces))
    frame = W.partitionBy("_piece").orderBy("_at").rowsBetween(-before, -1)
    found = dealt.withColumns({name: measure(frame) for name, measure in measures.items()})
    return found.where(F.col("_piece") == own).drop("_at", "_piece")


def _same_group(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on the keys where null equals null; the left side's keys stay."""
    there = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(there[f"_r_{k}"])
    return left.join(there, same, how).drop(*[f"_r_{k}" for k in keys])


def dense_index(df: DataFrame, key: str, name: str) -> DataFrame:
    """0-based position of every distinct non-null key in ascending order."""
    distinct = df.select(key).where(F.col(key).isNotNull()).distinct()
    return running(distinct, [key], {"_n": F.lit(1)}).select(key, (F.col("_n") - 1).cast("long").alias(name))


def weighted_positions(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values with the rows they cover: ``upto`` inclusive, ``n`` own, ``upto_total`` of the group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return running(counts, [value], {"upto": F.col("n")}, by=by, totals=True)


def value_at(positions: DataFrame, value: str, rank: Column) -> Column:
    """Aggregate: the value that covers the 0-based rank."""
    return F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col(value)))


def exact_quantiles(
    df: DataFrame, value: str, quantiles: Mapping[str, float], by: Sequence[str] = (), nearest: bool = False
) -> DataFrame:
    """Exact quantiles per group, linearly interpolated, or by the rank floor(q*n) when ``nearest``.

    Equal values are counted before any shuffle by value, so a constant column costs one row per task.
    """
    positions = weighted_positions(df, value, by)
    total = F.col("upto_total")
    parts = [F.max(total).alias("n_values")]
    for name, q in quantiles.items():
        if nearest:
            rank = F.least(F.floor(F.lit(float(q)) * total), total - 1)
            parts.append(value_at(positions, value, rank).alias(name))
            continue
        at = F.lit(float(q)) * (total - 1)
        parts += [
            value_at(positions, value, F.floor(at)).alias(f"_lo_{name}"),
            value_at(positions, value, F.ceil(at)).alias(f"_hi_{name}"),
            F.max(at - F.floor(at)).alias(f"_f_{name}"),
        ]
    out = positions.groupBy(*by).agg(*parts)
    picked = [
        F.col(name) if nearest
        else (F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_f_{name}")).alias(name)
        for name in quantiles
    ]
    return out.select(*by, "n_values", *picked)


def exact_median(df: DataFrame, value: str) -> Column:
    """One-row scalar: the exact median of a column."""
    return exact_quantiles(df, value, {"median": 0.5}).select("median").scalar()


def carry_forward(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str, ranges: int | None = None) -> DataFrame:
    """Adds the last non-null ``value`` at or before each row in the group's order.

    Every range is scanned on its own and starts from the last value of the group's earlier ranges.
    """
    by, order = list(by), list(order)
    ranged = assign_ranges(df, by + order, ranges)
    position = F.struct(*[F.col(c) for c in order])
    known = ranged.where(F.col(value).isNotNull()).groupBy(*by, "_range").agg(F.max_by(value, position).alias("_v"))
    spans = _same_group(ranged.select(*by, "_range").distinct(), known, [*by, "_range"], "left")
    earlier = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    start = spans.select(*by, "_range", F.last("_v", ignorenulls=True).over(earlier).alias("_start"))
    inside = W.partitionBy(*by, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = ranged.withColumn("_local", F.last(value, ignorenulls=True).over(inside))
    joined = _same_group(local, start, [*by, "_range"])
    return joined.select(*[F.col(c) for c in df.columns], F.coalesce("_local", "_start").alias(name))
