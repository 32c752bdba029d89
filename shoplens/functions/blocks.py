"""Products of large relations in blocks.

Scoring every row of one vector relation against every row of another is a matrix product. Left rows are hashed into blocks of
bounded size; a task holds one block, reads the right rows as they come, multiplies tile by tile with NumPy and keeps only what the
query needs: the best k per row so far, or a few totals. No pair leaves a task unless it is a result candidate. Only where there are
fewer blocks than the cluster runs at once is the right side cut into chunks too, whose candidates are ranked once more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.session import shared_folder

BLOCK_ROWS, LEFT_ROWS, SMALL_BLOCK = 2048, 1 << 14, 128
TILE_LEFT, TILE_RIGHT = 1024, 2048
SALT_ROWS, BROADCAST_BASKETS = 4096, 100_000
CHUNK_BASKETS, PART_ITEMS, CELL_PAIRS = 512, 64, 1 << 14
DIGITS = 6


def grid(left: DataFrame, right: DataFrame, block_rows: int) -> tuple[int, int]:
    """Blocks of the left side, of at most about ``block_rows`` rows, and chunks of the right side: of both no more than it takes
    to bound a block and to occupy the cluster, since every row of one side is copied for each of the other's."""
    slots, n, m = left.sparkSession.sparkContext.defaultParallelism, left.count(), right.count()
    small = min(SMALL_BLOCK, block_rows)
    blocks = max(1, math.ceil(n / block_rows), min(slots, math.ceil(n / small)))
    return blocks, max(1, min(math.ceil(slots / blocks), math.ceil(m / small)))


def _block(key: str, blocks: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)).cast("int")


def _copies(blocks: int):
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))


def _cells(left: DataFrame, right: DataFrame, skip: DataFrame | None, blocks: int, chunks: int) -> DataFrame:
    """A partition per cell of the grid: the rows of its left block, pairs to skip by their right row, then its right chunk by id."""
    none = F.lit(None).cast("long").alias("other")
    parts = [
        left.select(_block("id", blocks).alias("block"), _copies(chunks).alias("chunk"), F.lit(0).alias("part"), "id", none, "vector"),
        right.select(_copies(blocks).alias("block"), _block("id", chunks).alias("chunk"), F.lit(2).alias("part"), "id", none, "vector"),
    ]
    if skip is not None:
        empty = F.lit(None).cast(left.schema["vector"].dataType).alias("vector")
        pairs = skip.select("id", "other").distinct()
        parts.append(pairs.select(_block("id", blocks).alias("block"), _block("other", chunks).alias("chunk"), F.lit(1).alias("part"), F.col("other").alias("id"), F.col("id").alias("other"), empty))
    rows = reduce(DataFrame.unionByName, parts).withColumn("cell", F.col("block") * chunks + F.col("chunk"))
    return rows.repartitionById(blocks * chunks, "cell").sortWithinPartitions("part", "id").select("part", "id", "other", "vector")


def _matrix(vectors: pa.ListArray, cosine: bool) -> np.ndarray:
    """The vectors as rows, scaled to length 1 for cosines (a zero vector stays)."""
    if vectors.null_count or len(np.unique(np.diff(vectors.offsets.to_numpy()))) > 1:
        raise ValueError("vectors must all be there and have one length")
    out = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    if cosine:
        length = np.linalg.norm(out, axis=1, keepdims=True)
        length[length == 0] = 1.0
        out /= length
    return out


class _Cell:
    """The left rows of a cell, in order of id, and what it must skip; tiles() walks the right rows as they come."""

    def __init__(self, batches: Iterator[pa.RecordBatch], cosine: bool, skip_self: bool):
        self.batches, self.cosine, self.skip_self = batches, cosine, skip_self
        self.ids, self.left = np.zeros(0, np.int64), None

    def parts(self) -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in self.batches:
            part = batch["part"].to_numpy()
            borders = np.searchsorted(part, [0, 1, 2, 3])
            for p in range(3):
                if borders[p] < borders[p + 1]:
                    yield p, batch.slice(borders[p], borders[p + 1] - borders[p])

    def tiles(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """First left row, right ids, scores before rounding, and the places in them that don't count. Left rows without any
        right row bring no tile."""
        left, skips = ([], []), ([], [])
        for part, batch in self.parts():
            ids = batch["id"].to_numpy()
            if part == 0:
                left[0].append(ids)
                left[1].append(_matrix(batch["vector"], self.cosine))
            elif part == 1:
                skips[0].append(ids)
                skips[1].append(batch["other"].to_numpy())
            elif left[0]:
                if self.left is None:
                    self.ids, self.left = np.concatenate(left[0]), np.concatenate(left[1])
                    self.skip_right, self.skip_left = (np.concatenate(s) if s else np.zeros(0, np.int64) for s in skips)
                right = _matrix(batch["vector"], self.cosine)
                for j in range(0, len(ids), TILE_RIGHT):
                    yield from self._column(ids[j : j + TILE_RIGHT], right[j : j + TILE_RIGHT])

    def _column(self, ids: np.ndarray, right: np.ndarray):
        rows, columns = self._skipped(ids)
        for i in range(0, len(self.ids), TILE_LEFT):
            scores = self.left[i : i + TILE_LEFT] @ right.T
            here = (rows >= i) & (rows < i + TILE_LEFT)
            yield i, ids, scores, rows[here] - i, columns[here]

    def _skipped(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (left row, column) that don't count, every combination where ids repeat."""
        a, b = np.searchsorted(self.skip_right, [ids[0], ids[-1] + 1])
        who, what = self.skip_left[a:b], self.skip_right[a:b]
        if self.skip_self:
            who, what = np.concatenate([who, ids]), np.concatenate([what, ids])
        first, last = np.searchsorted(self.ids, who), np.searchsorted(self.ids, who, "right")
        who, what = _spread(first, last, what)
        first, last = np.searchsorted(ids, what), np.searchsorted(ids, what, "right")
        columns, rows = _spread(first, last, who)
        return rows, columns


def _spread(first: np.ndarray, last: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from ``first`` to below ``last``, each beside its value."""
    n = last - first
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(first, n) + inside, np.repeat(value, n)


def best_matches(
    left: DataFrame,
    right: DataFrame,
    k: int,
    cosine: bool = False,
    skip_self: bool = False,
    skip: DataFrame | None = None,
    block_rows: int = LEFT_ROWS,
) -> DataFrame:
    """The k highest-scoring right rows of every left row: (id, other, score, rank).

    Both sides have columns (id, vector). ``skip`` holds (id, other) pairs that must not be returned. Scores are
    rounded to six digits and ties go to the smaller id, so the result does not depend on the blocks.
    """
    return rank_rows(_cell_matches(left, right, k, cosine, skip_self, skip, block_rows, False), "id", "other", k)


def matches_and_range(left: DataFrame, right: DataFrame, k: int, cosine: bool = False, skip_self: bool = False, block_rows: int = LEFT_ROWS):
    """best_matches() and the (low, high) of all scores from one pass over the cells, whose rows are kept for both."""
    shared_folder(left.sparkSession)
    partial = _cell_matches(left, right, k, cosine, skip_self, None, block_rows, True).checkpoint()
    extremes = partial.agg(F.struct(F.min("score").alias("low"), F.max("score").alias("high")).alias("r")).scalar()
    return rank_rows(partial.where(F.col("other").isNotNull()), "id", "other", k), extremes


def _cell_matches(left: DataFrame, right: DataFrame, k: int, cosine: bool, skip_self: bool, skip: DataFrame | None, block_rows: int, lowest: bool) -> DataFrame:
    """The best k of each row within each cell, and with ``lowest`` a row without ``other`` for each cell's least score."""
    blocks, chunks = grid(left, right, block_rows)
    if skip is not None:  # only pairs whose two sides are there matter
        skip = skip.select("id", "other").join(left.select("id"), "id", "left_semi").join(
            right.select(F.col("id").alias("other")), "other", "left_semi"
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, best, least = _Cell(batches, cosine, skip_self), None, np.inf
        for i, ids, scores, rows, columns in cell.tiles():
            if best is None:
                best = _Best(len(cell.ids), k)
            if lowest:
                scores[rows, columns] = np.nan
                least = min(least, np.nanmin(scores, initial=np.inf))
            scores[rows, columns] = -np.inf
            best.take(i, ids, scores)
        if best is None:
            return
        for i in range(0, len(cell.ids), TILE_LEFT):
            score, other = best.score[i : i + TILE_LEFT], best.other[i : i + TILE_LEFT]
            found = score > -np.inf
            values = [np.repeat(cell.ids[i : i + TILE_LEFT], found.sum(axis=1)), other[found], score[found]]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["id", "other", "score"])
        if least < np.inf:
            yield pa.RecordBatch.from_arrays([pa.array(cell.ids[:1]), pa.array([None], pa.int64()), pa.array([np.round(least, DIGITS) + 0.0])], names=["id", "other", "score"])

    return _cells(left, right, skip, blocks, chunks).mapInArrow(run, "id long, other long, score double")


class _Best:
    """The best k of every left row so far: rounded scores falling, of equal ones the smaller id first. Right ids never fall, so a
    score that only equals a row's last one comes too late."""

    def __init__(self, rows: int, k: int):
        self.k, self.score, self.other = k, np.full((rows, k), -np.inf), np.zeros((rows, k), np.int64)

    def take(self, start: int, ids: np.ndarray, scores: np.ndarray) -> None:
        at, n = slice(start, start + len(scores)), scores.shape[1]
        last = self.score[at, -1]
        least = last
        if n > self.k and (last == -np.inf).any():  # many would do: only those above the k-th of the tile can stay
            scores[np.isnan(scores)] = -np.inf
            least = np.maximum(last, np.partition(scores, n - self.k, axis=1)[:, n - self.k])
        row, column = np.nonzero(scores >= (least - 10.0**-DIGITS)[:, None])
        value = np.round(scores[row, column], DIGITS) + 0.0
        good = value > last[row]
        row, column, value = row[good], column[good], value[good]
        if not len(row):
            return
        touched, own = np.unique(row, return_inverse=True)
        here = start + touched
        row = np.concatenate([np.repeat(np.arange(len(touched)), self.k), own])
        value = np.concatenate([self.score[here].ravel(), value])
        other = np.concatenate([self.other[here].ravel(), ids[column]])
        order = np.lexsort((-value, row))  # stable: what is there already, and smaller ids, first
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(touched)))[row]
        order = order[place < self.k]
        self.score[here], self.other[here] = value[order].reshape(-1, self.k), other[order].reshape(-1, self.k)


def rank_rows(scored: DataFrame, key: str, other: str, k: int, score: str = "score") -> DataFrame:
    """Keep the k best rows per key by (score descending, other ascending) and number them."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy(key).orderBy(F.col(score).desc(), F.col(other)))
    return scored.withColumn("rank", place).where(F.col("rank") <= k)


def score_totals(left: DataFrame, right: DataFrame, cosine: bool, skip_self: bool, block_rows: int = LEFT_ROWS) -> DataFrame:
    """Per left row over all right rows: pairs, sum, min, max and number of non-zero scores, without emitting pairs."""
    blocks, chunks = grid(left, right, block_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, found = _Cell(batches, cosine, skip_self), None
        for i, _, scores, rows, columns in cell.tiles():
            if found is None:
                n = len(cell.ids)
                found = [np.zeros(n, np.int64), np.zeros(n), np.full(n, np.inf), np.full(n, -np.inf), np.zeros(n, np.int64)]
            scores[rows, columns] = np.nan
            scores = np.round(scores, DIGITS) + 0.0
            seen, at = ~np.isnan(scores), slice(i, i + len(scores))
            filled = np.where(seen, scores, 0.0)
            found[0][at] += seen.sum(axis=1)
            found[1][at] += filled.sum(axis=1)
            found[2][at] = np.minimum(found[2][at], np.where(seen, scores, np.inf).min(axis=1))
            found[3][at] = np.maximum(found[3][at], np.where(seen, scores, -np.inf).max(axis=1))
            found[4][at] += (filled != 0).sum(axis=1)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (cell.ids, *found)], names=["id", "pairs", "total", "low", "high", "nonzero"])

    partial = _cells(left, right, None, blocks, chunks).mapInArrow(run, "id long, pairs long, total double, low double, high double, nonzero long")
    return partial.groupBy("id").agg(
        F.sum("pairs").alias("pairs"), F.sum("total").alias("total"), F.min("low").alias("low"),
        F.max("high").alias("high"), F.sum("nonzero").alias("nonzero"),
    )


def salt_count(size: Column, rows: int) -> Column:
    """Salts of a basket: one for every ``rows`` items, so that a hot basket is dealt out as far as its size asks for."""
    return F.greatest(F.ceil(size / F.lit(rows)), F.lit(1)).cast("int")


def salted(baskets: DataFrame, sizes: DataFrame, basket: str, item: str, rows: int = SALT_ROWS) -> DataFrame:
    """The rows with a ``_salt`` below their basket's salt_count(); ``sizes`` has the measured basket_size.

    Only baskets of more than ``rows`` items need one, at most a table of all rows / ``rows``, which is broadcast where its
    counted length is small.
    """
    heavy = sizes.where(F.col("basket_size") > rows).select(basket, salt_count(F.col("basket_size"), rows).alias("_salts"))
    n = heavy.count()
    if n == 0:
        return baskets.withColumn("_salt", F.lit(0))
    marked = baskets.join(F.broadcast(heavy) if n <= BROADCAST_BASKETS else heavy, basket, "left")
    return marked.withColumn("_salt", F.pmod(F.xxhash64(item), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")


def with_sizes(baskets: DataFrame, basket: str, item: str, smallest: int = 1, largest: int | None = None, rows: int = SALT_ROWS) -> DataFrame:
    """Distinct (basket, item) rows with the basket's number of items, for baskets within the given sizes.

    Counts are combined in every task and joined back on the basket and a salt, whose number follows from the measured size:
    a basket with a third of all rows meets its count in as many places as it has ``rows`` items.
    """
    sizes = baskets.groupBy(basket).agg(F.count(F.lit(1)).alias("basket_size")).where(F.col("basket_size") >= smallest)
    if largest is not None:
        sizes = sizes.where(F.col("basket_size") <= largest)
    copies = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0), salt_count(F.col("basket_size"), rows) - 1)))
    return salted(baskets, sizes, basket, item, rows).join(copies, [basket, "_salt"]).drop("_salt")


def pair_counts(baskets: DataFrame, basket: str, item: str, light: int = 50, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Baskets that contain both items, for every unordered pair a < b: (a, b, together).

    ``baskets`` has distinct (basket, item) rows. Baskets of at most ``light`` items list their pairs in one row, at most
    light*(light-1)/2 each. Larger ones list them by parts of the basket, in as many rows as its size asks for; from the size
    on at which they share enough pairs, they are counted as a product of item blocks over chunks of baskets, of which only
    summed counts leave. The sized rows are read several times and therefore kept in the shared folder.
    """
    shared_folder(baskets.sparkSession)
    return sized_pair_counts(with_sizes(baskets, basket, item, smallest=2).checkpoint(), basket, item, light, block_rows)


def sized_pair_counts(sized: DataFrame, basket: str, item: str, light: int = 50, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """pair_counts() of rows that carry their basket_size already; they are read several times."""
    once = F.lit(1).cast("long").alias("together")
    found = _light_pairs(sized.where(F.col("basket_size") <= light), basket, item).select("a", "b", once)
    heavy = sized.where(F.col("basket_size") > light)
    grid = _product_grid(heavy, item, block_rows)
    if grid is not None:
        least, chunks, blocks = grid
        listed = heavy if least is None else heavy.where(F.col("basket_size") < least)
        found = found.unionByName(_part_pairs(listed, basket, item).select("a", "b", once))
        if least is not None:
            found = found.unionByName(_heavy_pairs(heavy.where(F.col("basket_size") >= least), basket, item, chunks, blocks))
    return found.groupBy("a", "b").agg(F.sum("together").alias("together"))


def listed_pairs(sized: DataFrame, basket: str, item: str, largest: int, smallest: int = 2) -> DataFrame:
    """Pair counts over baskets whose size (column basket_size) lies in [smallest, largest] only; others are ignored
    by definition."""
    pairs = _light_pairs(sized.where(F.col("basket_size").between(max(smallest, 2), largest)), basket, item)
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("together"))


def _light_pairs(baskets: DataFrame, basket: str, item: str) -> DataFrame:
    lists = baskets.groupBy(basket).agg(F.sort_array(F.collect_list(item)).alias("items"))
    first = lists.select(F.posexplode("items").alias("at", "a"), "items")
    return first.select("a", F.explode(F.expr("slice(items, at + 2, size(items))")).alias("b"))


def _part_pairs(rows: DataFrame, basket: str, item: str) -> DataFrame:
    """The pairs of baskets of any size: items are dealt to parts of about PART_ITEMS, and any two parts of a basket meet in a row."""
    parts = rows.select(F.col(basket).alias("basket"), F.col(item).alias("item"), salt_count(F.col("basket_size"), PART_ITEMS).alias("parts"))
    dealt = parts.select(
        "basket", "item", F.pmod(F.xxhash64("item"), "parts").cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("opposite")
    )
    met = dealt.groupBy("basket", F.least("own", "opposite").alias("lp"), F.greatest("own", "opposite").alias("rp")).agg(
        F.collect_list(F.when(F.col("own") <= F.col("opposite"), F.col("item"))).alias("left"),
        F.collect_list(F.when(F.col("own") >= F.col("opposite"), F.col("item"))).alias("right"),
    )
    first = met.select((F.col("lp") == F.col("rp")).alias("same"), F.explode("left").alias("x"), "right")
    pairs = first.select("same", "x", F.explode("right").alias("y")).where(~F.col("same") | (F.col("x") < F.col("y")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _product_grid(rows: DataFrame, item: str, block_rows: int) -> tuple[int | None, int, int] | None:
    """(least basket size, chunks, blocks) of the block product, with None for the size where no cells would be filled, and None
    without rows.

    Every cell of a chunk and two blocks costs a call. The more items there are, the fewer pairs a cell holds, so only baskets
    from the smallest power of two take part that bring CELL_PAIRS pairs to the mean cell. Reads one row per power of two.
    """
    size = F.col("basket_size")
    powers = rows.select(F.floor(F.log2(size)).cast("int").alias("power"), item, size).rollup("power").agg(
        F.sum(F.lit(1.0) / size).alias("baskets"), F.sum((size - 1) / 2).alias("pairs"), F.approx_count_distinct(item).alias("items")
    )
    counted = {r["power"]: r for r in powers.collect() if r["baskets"]}
    if not counted:
        return None
    blocks = max(1, math.ceil(counted.pop(None)["items"] / block_rows))
    for power in sorted(counted):
        above = [r for p, r in counted.items() if p >= power]
        chunks = max(1, math.ceil(round(sum(r["baskets"] for r in above), 3) / CHUNK_BASKETS))
        if sum(r["pairs"] for r in above) >= CELL_PAIRS * chunks * blocks * (blocks + 1) / 2:
            return 1 << power, chunks, blocks
    return None, 1, blocks


def _heavy_pairs(rows: DataFrame, basket: str, item: str, chunks: int, blocks: int) -> DataFrame:
    kind = rows.schema[item].dataType.simpleString()
    schema = f"a {kind}, b {kind}, together bigint"
    keyed = rows.select(
        F.pmod(F.xxhash64(basket), F.lit(chunks)).cast("int").alias("chunk"), _block(item, blocks).alias("own"),
        F.col(basket).alias("basket"), F.col(item).alias("item"), salt_count(F.col("basket_size"), SALT_ROWS).alias("salts"),
    )
    # a row of block x takes part in the cells of x with the blocks that its basket has items in; the items of a basket meet
    # the list of its blocks in as many places as its size asks for
    present = keyed.select("basket", "salts", F.col("own").alias("opposite")).distinct()
    present = present.select("basket", "opposite", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    cells = keyed.withColumn("salt", F.pmod(F.xxhash64("item"), "salts").cast("int")).join(present, ["basket", "salt"]).select(
        "chunk", F.least("own", "opposite").alias("lb"), F.greatest("own", "opposite").alias("rb"), "own", "basket", "item"
    )

    def cell_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        lb, rb = int(pdf.lb.iat[0]), int(pdf.rb.iat[0])
        who, people = pd.factorize(pdf.basket)
        left, right = (pdf.own == lb).to_numpy(), (pdf.own == rb).to_numpy()
        items_l, at_l = np.unique(pdf.item[left].to_numpy(), return_inverse=True)
        items_r, at_r = np.unique(pdf.item[right].to_numpy(), return_inverse=True)
        a = np.zeros((len(people), len(items_l)), dtype=np.float32)
        b = np.zeros((len(people), len(items_r)), dtype=np.float32)
        a[who[left], at_l] = 1
        b[who[right], at_r] = 1
        counts = a.T @ b
        if lb == rb:
            counts = np.triu(counts, 1)
        i, j = np.nonzero(counts)
        x, y = items_l[i], items_r[j]
        return pd.DataFrame(
            {"a": np.minimum(x, y), "b": np.maximum(x, y), "together": counts[i, j].astype(np.int64)}
        )

    return cells.groupBy("chunk", "lb", "rb").applyInPandas(cell_pairs, schema)
