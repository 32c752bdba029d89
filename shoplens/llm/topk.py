"""Exact top-k by inner product with KD-trees per shard.

A bounded sample gives the top splits, so near vectors share a cell; a cell with many rows is dealt out over shards by key.
Every shard builds a tree by median splits, with the tight bounding box of every node. A query first searches its home
shard. The k-th score found there travels with it: cells whose box cannot reach it are never sent the query, and inside
a shard leaves are visited in the order of their boxes' bounds until no bound reaches the k-th score. A node's box lies in
its parent's, so that order over leaves is the order of a best-first walk; queries walk in blocks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoplens.llm.common import ODD, Tables

SAMPLE = 4096
SHARD_ROWS = 4096
LEAF_ROWS = 64
BLOCK = 1024
TURN_QUERIES = 1 << 16
EXACT = 2.0**52
NONE = np.iinfo(np.int64).min


def whole_numbers(vector: str, factor: int = 256) -> Column:
    """floor(factor * x) per component, null where the vector is null or has a null or non-finite component. Products
    beyond the long range stop at its ends."""
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.when(F.col(vector).isNotNull() & ~F.exists(vector, odd), F.transform(vector, lambda x: F.floor(x.cast("double") * factor)))


def _stack(rows, width: int = 0) -> np.ndarray:
    """Vectors as a matrix; shorter ones are filled with zeros."""
    width = max([width, *map(len, rows)]) if len(rows) else width
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _wider(values: np.ndarray, width: int) -> np.ndarray:
    return np.pad(values, ((0, 0), (0, width - values.shape[1]))) if values.shape[1] < width else values


def _split(values: np.ndarray, rows: np.ndarray) -> tuple[int, np.ndarray, np.ndarray] | None:
    """The widest dimension and the rows below and above its median; None where all rows are alike."""
    part = values[rows]
    if not part.size or not (spread := part.max(0).astype(float) - part.min(0)).max() > 0:
        return None
    dim = int(spread.argmax())
    order = rows[np.argsort(part[:, dim], kind="stable")]
    return dim, order[: len(order) // 2], order[len(order) // 2 :]


class Splits:
    """Top splits of the space, learned from a sample."""

    def __init__(self, values: np.ndarray, cells: int):
        self.nodes: list[tuple] = []
        self.cells = 0
        self._grow(values, np.arange(len(values)), cells)

    def _grow(self, values, rows, cells) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        halves = _split(values, rows) if cells > 1 and len(rows) > 1 else None
        if halves is None:
            self.nodes[at] = (-1, 0, self.cells, self.cells)
            self.cells += 1
            return at
        dim, low, high = halves
        self.nodes[at] = (dim, int(values[high[0], dim]), self._grow(values, low, cells // 2), self._grow(values, high, cells - cells // 2))
        return at

    def cell(self, values: np.ndarray) -> np.ndarray:
        out, stack = np.zeros(len(values), np.int64), [(0, np.arange(len(values)))]
        while stack:
            at, rows = stack.pop()
            dim, border, low, high = self.nodes[at]
            if dim < 0:
                out[rows] = low
                continue
            above = values[rows, dim] >= border if dim < values.shape[1] else np.full(len(rows), border <= 0)
            stack += [(low, rows[~above]), (high, rows[above])]
        return out


class Tree:
    """Rows of a shard in the order of the leaves of a KD-tree, with the box of every leaf."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        leaves, stack = [], [np.arange(len(ids))]
        while stack:
            rows = stack.pop()
            halves = _split(values, rows) if len(rows) > LEAF_ROWS else None
            if halves is None:
                leaves += [rows[i : i + LEAF_ROWS] for i in range(0, len(rows), LEAF_ROWS)]
            else:
                stack += [halves[2], halves[1]]
        order = np.concatenate(leaves)
        self.ids, self.values = ids[order], values[order]
        self.starts = np.cumsum([0, *map(len, leaves)])
        self.low = np.stack([values[rows].min(0) for rows in leaves])
        self.high = np.stack([values[rows].max(0) for rows in leaves])


def _largest(values: np.ndarray) -> float:
    return float(np.abs(values.astype(np.float64)).max()) if values.size else 0.0


def _products(left: np.ndarray, right: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as longs: by floating point where that is exact, else in unbounded integers."""
    if exact:
        return (left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
    return np.clip(left.astype(object) @ right.T.astype(object), NONE + 1, np.iinfo(np.int64).max).astype(np.int64)


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The greatest inner product that any point of each box can have with each query, rounded up generously."""
    q = queries.astype(np.float64)
    found = np.maximum(q, 0) @ high.T.astype(np.float64) + np.minimum(q, 0) @ low.T.astype(np.float64)
    slack = np.abs(q) @ np.maximum(np.abs(low.astype(np.float64)), np.abs(high.astype(np.float64))).T * 1e-12
    return found + slack


def search(tree: Tree, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores (NONE where there are fewer) of each query's best k rows that reach ``floor``, its k-th score so far."""
    width = max(queries.shape[1], tree.values.shape[1])
    queries, values = _wider(queries, width), _wider(tree.values, width)
    exact = _largest(queries) * _largest(values) * max(width, 1) < EXACT
    reach = bounds(queries, _wider(tree.low, width), _wider(tree.high, width))
    order = np.argsort(-reach, axis=1, kind="stable")
    best, named, kth = np.full((len(ids), k), NONE), np.full((len(ids), k), NONE), floor.copy()
    for step in range(order.shape[1]):
        leaf = order[:, step]
        open_ = np.flatnonzero((reach[np.arange(len(ids)), leaf] >= kth) | (kth == NONE))
        if not len(open_):
            break
        for one in np.unique(leaf[open_]):
            rows = open_[leaf[open_] == one]
            part = slice(tree.starts[one], tree.starts[one + 1])
            scores = _products(queries[rows], values[part], exact)
            names = np.broadcast_to(tree.ids[part], scores.shape)
            scores = np.where((names == ids[rows][:, None]) | (scores < kth[rows][:, None]), NONE, scores)
            scores, names = np.hstack([best[rows], scores]), np.hstack([named[rows], names])
            top = np.lexsort((names, ~scores), axis=-1)[:, :k]  # ~x falls as x grows, without overflow
            best[rows], named[rows] = np.take_along_axis(scores, top, 1), np.take_along_axis(names, top, 1)
        kth = np.maximum(kth, best[:, -1])
    return named, best


RESULT = "query_id bigint, vec_id bigint, score bigint"


def _found(ids: np.ndarray, named: np.ndarray, best: np.ndarray) -> pd.DataFrame:
    at, place = np.nonzero(best != NONE)
    return pd.DataFrame({"query_id": ids[at], "vec_id": named[at, place], "score": best[at, place]})


def top_k(rows: DataFrame, queries: DataFrame, tables: Tables, k: int = 5, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best rows by inner product, ties to the smaller id.

    Both sides have id and numbers (array of long, null: takes no part). A query never meets rows with its own id. Rows or
    queries with a null id cannot be named and take no part. Rows alike in id and numbers count once; a query id that comes
    several times stands for its least vector. Vectors of unequal length are compared as if filled with zeros, empty ones
    score 0. All rows, if there are fewer than k. Empty tables give none.
    """
    usable = lambda df: df.select(F.col("id").cast("long").alias("id"), "numbers").where("id is not null and numbers is not null")
    rows = tables.keep("rows", usable(rows).dropDuplicates(["id", "numbers"]))
    queries = tables.keep("queries", usable(queries).groupBy("id").agg(F.min("numbers").alias("numbers")))
    n = rows.count()
    drawn = rows.orderBy(F.xxhash64("id", "numbers"), "id", "numbers").limit(sample).select("numbers").collect()
    splits = Splits(_stack([r["numbers"] for r in drawn]), min(-(-n // shard_rows), sample // 8))

    def placed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(cell=splits.cell(_stack(part["numbers"].to_numpy())) if len(part) else [])

    schema = "id bigint, numbers array<bigint>, cell bigint"
    celled = tables.keep("cells", rows.mapInPandas(placed, schema))
    counts = dict(celled.groupBy("cell").count().collect())
    shards = {cell: max(1, -(-m // shard_rows)) for cell, m in counts.items()}
    if not shards:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score")).limit(0)
    spread = F.create_map(*[F.lit(x) for pair in sorted(shards.items()) for x in pair])
    salted = lambda df: df.withColumn("salt", F.pmod(F.xxhash64("id", "numbers"), spread[F.col("cell")]))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(part["id"].to_numpy(), _stack(part["numbers"].to_numpy()))
        first = part.iloc[0]
        return pd.DataFrame({"cell": [first["cell"]], "salt": [first["salt"]], "tree": [pickle.dumps(tree, 5)]})

    trees = tables.keep("trees", salted(celled).groupBy("cell", "salt").applyInPandas(build, "cell bigint, salt bigint, tree binary"))
    box = celled.select("cell", F.posexplode("numbers").alias("dim", "x")).groupBy("cell", "dim").agg(F.min("x"), F.max("x"), F.count("x"))
    edges = box.collect()  # cells x dimensions
    width = 1 + max([r["dim"] for r in edges], default=-1)
    low, high = np.zeros((splits.cells, width), np.int64), np.zeros((splits.cells, width), np.int64)
    for cell, dim, least, most, m in edges:
        short = m < counts[cell]  # some vectors end before this dimension and hold 0 there
        low[cell, dim], high[cell, dim] = (min(least, 0), max(most, 0)) if short else (least, most)

    def at_home(key, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids = asked["id"].to_numpy()
        return _found(ids, *search(pickle.loads(held["tree"][0]), ids, _stack(asked["numbers"].to_numpy()), np.full(len(ids), NONE), k))

    known = F.array(*[F.lit(c) for c in sorted(shards)])
    homes = queries.mapInPandas(placed, schema)
    homes = tables.keep("homes", salted(homes.withColumn("cell", F.when(F.array_contains(known, F.col("cell")), F.col("cell")).otherwise(F.lit(min(shards))))))
    first = tables.keep("first", homes.groupBy("cell", "salt").cogroup(trees.groupBy("cell", "salt")).applyInPandas(at_home, RESULT))
    kth = first.groupBy("query_id").agg(F.when(F.count("score") >= k, F.min("score")).alias("kth"))
    asked = homes.join(kth, homes["id"] == kth["query_id"], "left").select("id", "numbers", "cell", "salt", "kth")

    turns = -(-queries.count() // TURN_QUERIES) or 1

    def sent(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for start in range(0, len(part), BLOCK):
                block = part.iloc[start : start + BLOCK]
                vectors = _wider(_stack(block["numbers"].to_numpy()), width)
                floor = np.array([NONE if pd.isna(x) else int(x) for x in block["kth"].astype(object)], np.int64)
                ids, home, salt = (block[c].to_numpy() for c in ("id", "cell", "salt"))
                edge = [np.pad(x, ((0, 0), (0, vectors.shape[1] - width))) for x in (low, high)]
                reach = bounds(vectors, *edge)
                for cell in shards:
                    rows_ = np.flatnonzero((reach[:, cell] >= floor) | (floor == NONE))
                    own = np.where(home[rows_] == cell, salt[rows_], -1)  # the shard that has been searched already
                    for seen in np.unique(own):
                        part_ = rows_[own == seen]
                        packed = pickle.dumps((ids[part_], vectors[part_], floor[part_]), 5)
                        yield pd.DataFrame({"cell": [cell], "seen": [seen], "turn": [(int(ids[part_[0]]) * int(ODD) >> 32) % turns], "block": [packed]})

    def elsewhere(key, blocks: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []})]
        if not len(blocks):
            return out[0]
        tree = pickle.loads(held["tree"][0])
        for block in blocks["block"]:
            ids, vectors, floor = pickle.loads(block)
            out.append(_found(ids, *search(tree, ids, vectors, floor, k)))
        return pd.concat(out[1:]) if len(out) > 1 else out[0]

    blocks = asked.mapInPandas(sent, "cell bigint, seen bigint, turn bigint, block binary")
    # A salt may have drawn no row: blocks meet the shards that exist. A shard answers many queries in several turns.
    there = tables.keep("there", trees.select("cell", "salt"))
    meant = blocks.join(there, "cell").where("salt <> seen").select("cell", "salt", "turn", "block")
    held = trees.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1)).cast("array<bigint>")))
    rest = meant.groupBy("cell", "salt", "turn").cogroup(held.groupBy("cell", "salt", "turn")).applyInPandas(elsewhere, RESULT)
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS numbers FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.numbers, v.numbers) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
