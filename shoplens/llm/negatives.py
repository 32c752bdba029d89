"""Hard-negative mining: Hilbert-ordered candidate blocks in Parquet, with per-dimension zone maps.

Candidates are sorted along a Hilbert curve through the cells of the dimensions that vary most, and cut into blocks of
BLOCK_ROWS. A block is one row of a Parquet table: its vectors, and its zone map, the least and the greatest value of every
dimension with the labels that occur. Interval arithmetic over a zone map encloses every score that an anchor can have in
the block, and only blocks whose interval meets what an anchor still looks for are read for it:

- its positives: blocks with its label whose upper end reaches the fifth best score in the block with the greatest upper end;
- its windows: blocks with another label whose interval meets a window, above the third best score already found in it.

Zone maps meet anchors chunk by chunk, so no task or driver holds all of either. The curve is placed by a bounded sample of
SAMPLE rows; it decides only how much is read, every row is in a block and results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoplens.llm.common import Tables
from shoplens.llm.topk import NONE, _largest, _products, _stack, _wider, bounds

SAMPLE = 4096
BLOCK_ROWS = 1024
CURVE_DIMS, CURVE_BITS = 8, 7
CHUNK_ANCHORS, CHUNK_ZONES = 256, 1024
GROUP_ANCHORS = 4096
EXACT = 2.0**52
# Positives per anchor, negatives per positive, and the window of scores in hundredths of the positive's.
POSITIVES, NEGATIVES, LEAST, MOST = 5, 3, 50, 95

ASKED = "block bigint, salt bigint, id bigint, label bigint, numbers array<bigint>, floor bigint, wins array<struct<place:int,positive_id:bigint,score:bigint,floor:bigint>>"
FOUND = "id bigint, place int, vec_id bigint, score bigint"
NO_VISITS = pd.DataFrame({name: [] for name in ("block", "salt", "id", "label", "numbers", "floor", "wins")}, dtype=object)


def hilbert_positions(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of every row of cell numbers (rows x dimensions, each below 2**bits) along the Hilbert curve."""
    axes = [cells[:, d].astype(np.int64) for d in range(cells.shape[1])]
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for d in range(len(axes)):
            set_ = (axes[d] >> bit) & 1 == 1
            swap = np.where(set_, 0, (axes[0] ^ axes[d]) & low)  # for d = 0 nothing is exchanged
            axes[0] = np.where(set_, axes[0] ^ low, axes[0] ^ swap)
            if d:
                axes[d] = axes[d] ^ swap
    for d in range(1, len(axes)):
        axes[d] = axes[d] ^ axes[d - 1]
    flip = np.zeros(len(cells), np.int64)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((axes[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    position = np.zeros(len(cells), np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            position = position << 1 | ((axis ^ flip) >> bit) & 1
    return position


class Curve:
    """Which dimensions the curve runs through and the borders of their cells, from a sample."""

    def __init__(self, sample: np.ndarray, dims: int = CURVE_DIMS, bits: int = CURVE_BITS):
        spread = sample.astype(np.float64).var(0) if len(sample) else np.zeros(0)
        self.bits, self.dims = bits, np.argsort(-spread, kind="stable")[:dims]
        shares = np.arange(1, 1 << bits) / (1 << bits)
        self.borders = [np.quantile(sample[:, d], shares) for d in self.dims]

    def positions(self, values: np.ndarray) -> np.ndarray:
        if not len(self.dims):
            return np.zeros(len(values), np.int64)
        values = _wider(values, int(self.dims.max()) + 1)
        cells = np.stack([np.searchsorted(b, values[:, d], "right") for d, b in zip(self.dims, self.borders)], 1)
        return hilbert_positions(cells, self.bits)


def candidate_blocks(rows: DataFrame, tables: Tables, block_rows: int = BLOCK_ROWS, sample: int = SAMPLE) -> DataFrame:
    """block, low, high, labels (the zone map), width, ids, codes and vectors of every block, as a Parquet table."""
    drawn = rows.orderBy(F.xxhash64("id", "numbers", "label"), "id", "numbers", "label").limit(sample).select("numbers").collect()
    curve = Curve(_stack([r["numbers"] for r in drawn]))

    def placed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(position=curve.positions(_stack(part["numbers"].to_numpy())) if len(part) else [])

    along = tables.keep("along", rows.mapInPandas(placed, "id bigint, label bigint, numbers array<bigint>, position bigint"))
    blocks = -(-along.count() // block_rows)
    parallel = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(blocks, parallel), blocks // 64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, number = TaskContext.get().partitionId() << 32, [], 0

        def block(part: pa.Table) -> pa.RecordBatch:
            part = part.sort_by([("id", "ascending")])  # ties in score go to the smaller id
            values, codes = _stack(part["numbers"].to_pylist()), part["label"].to_numpy()
            columns = [[first + number], [values.min(0).tolist()], [values.max(0).tolist()], [sorted(set(codes.tolist()))], [values.shape[1]], [part["id"].to_numpy().tobytes()], [codes.tobytes()], [values.tobytes()]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["block", "low", "high", "labels", "width", "ids", "codes", "vectors"])

        for batch in batches:
            while batch.num_rows:
                room = block_rows - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == block_rows:
                    yield block(pa.Table.from_batches(held))
                    held, number = [], number + 1
        if held:
            yield block(pa.Table.from_batches(held))

    order = ["position", "id", "label", "numbers"]
    ordered = along.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "label", "numbers")
    schema = "block bigint, low array<bigint>, high array<bigint>, labels array<bigint>, width int, ids binary, codes binary, vectors binary"
    made = tables.keep("blocks", ordered.mapInArrow(cut, schema))
    tables.drop("along")
    return made


def intervals(vectors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of an interval that holds every inner product of each vector with each box's points."""
    return -bounds(-vectors, low, high), bounds(vectors, low, high)


def window(score: int) -> tuple[int, int]:
    """Least and greatest whole score within LEAST to MOST hundredths of ``score``."""
    return -(-LEAST * score // 100), MOST * score // 100


def _windows(wins) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower ends, upper ends and floors (the score a negative must reach) per anchor and place; 1 to 0 where there is none."""
    ends = np.tile(np.array([1, 0, 1], np.int64), (len(wins), POSITIVES, 1))
    for i, row in enumerate(wins):
        for win in row:
            low, high = window(int(win["score"]))
            floor = win["floor"]
            ends[i, win["place"] - 1] = low, high, low if floor is None or pd.isna(floor) else max(low, int(floor))
    return ends[..., 0], ends[..., 1], ends[..., 2]


def _asked(parts: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return parts["id"].to_numpy(), parts["label"].to_numpy(), _stack(parts["numbers"].to_numpy())


def _scores(asked: pd.DataFrame, block) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors in slices with the block's ids, scores and whether the label is the anchor's; NONE for the anchor's own rows."""
    names, codes = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["codes"], np.int64)
    values = np.frombuffer(block["vectors"], np.int64).reshape(len(names), block["width"])
    for start in range(0, len(asked), BLOCK_ROWS):
        part = asked.iloc[start : start + BLOCK_ROWS]
        ids, labels, vectors = _asked(part)
        width = max(vectors.shape[1], values.shape[1])
        left, right = _wider(vectors, width), _wider(values, width)
        scores = _products(left, right, _largest(left) * _largest(right) * max(width, 1) < EXACT)
        scores[ids[:, None] == names[None, :]] = NONE
        yield part, names, scores, labels[:, None] == codes[None, :]


def _frame(ids, place, names, scores) -> pd.DataFrame:
    return pd.DataFrame({"id": ids, "place": np.asarray(place, np.int32), "vec_id": names, "score": scores})


def positives_in(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """Each anchor's best rows of its label in the block, as far as they reach its floor."""
    out = [_frame([], [], [], [])]
    if len(asked) and len(held):
        for part, names, scores, same in _scores(asked, held.iloc[0]):
            floor = part["floor"].fillna(NONE).to_numpy(np.int64) if part["floor"].isna().any() else part["floor"].to_numpy(np.int64)
            scores = np.where(same & (scores >= floor[:, None]), scores, NONE)
            first = np.argsort(~scores, axis=1, kind="stable")[:, :POSITIVES]
            best = np.take_along_axis(scores, first, 1)
            at, place = np.nonzero(best != NONE)
            out.append(_frame(part["id"].to_numpy()[at], np.zeros(len(at)), names[first[at, place]], best[at, place]))
    return pd.concat(out[1:]) if len(out) > 1 else out[0]


def negatives_in(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """The highest scores of other labels within each of an anchor's windows."""
    out = [_frame([], [], [], [])]
    if len(asked) and len(held):
        for part, names, scores, same in _scores(asked, held.iloc[0]):
            scores = np.where(same, NONE, scores)
            order = np.argsort(~scores, axis=1, kind="stable")
            falling = np.take_along_axis(scores, order, 1)
            _, high, floor = _windows(part["wins"])
            ids = part["id"].to_numpy()
            for place in range(POSITIVES):
                start = (falling > high[:, place, None]).sum(1)
                for step in range(NEGATIVES):
                    at = np.flatnonzero(start + step < falling.shape[1])
                    best = falling[at, start[at] + step]
                    keep = (best >= floor[at, place]) & (best != NONE) & (floor[at, place] <= high[at, place])
                    at, best = at[keep], best[keep]
                    out.append(_frame(ids[at], np.full(len(at), place + 1), names[order[at, start[at] + step]], best))
    return pd.concat(out[1:]) if len(out) > 1 else out[0]


class Miner:
    """Anchors and blocks of one run."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, tables: Tables, block_rows: int = BLOCK_ROWS, chunk_anchors: int = CHUNK_ANCHORS, chunk_zones: int = CHUNK_ZONES):
        usable = lambda df: df.select(F.col("id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), "numbers").dropna()
        self.tables = tables
        # Of rows alike in label and vector only the first ids can be among an anchor's positives or a window's negatives: they
        # tie with every anchor, ties go to the smaller id, and one id may be the anchor's own.
        alike = F.row_number().over(W.partitionBy("numbers", "label").orderBy("id"))
        rows = usable(rows).dropDuplicates(["id", "label", "numbers"]).withColumn("alike", alike).where(F.col("alike") <= max(POSITIVES, NEGATIVES) + 1)
        rows = tables.keep("rows", rows.drop("alike"))
        least = usable(anchors).groupBy("id").agg(F.min(F.struct("numbers", "label")).alias("a"))
        self.anchors = tables.keep("anchors", least.select("id", "a.label", "a.numbers"))
        self.blocks = candidate_blocks(rows, tables, block_rows)
        tables.drop("rows")
        self.chunks = -(-self.anchors.count() // chunk_anchors) or 1
        self.zone_chunks = -(-self.blocks.count() // chunk_zones) or 1
        self.salts = -(-self.chunks * chunk_anchors // GROUP_ANCHORS)

    def against_zones(self, anchors: DataFrame, route, schema: str) -> DataFrame:
        """``route(anchors, zones)`` of every chunk of anchors and chunk of zone maps, one of each in a group."""
        chunk = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
        left = anchors.withColumn("chunk", chunk("id", self.chunks)).withColumn("zones", every(self.zone_chunks))
        right = self.blocks.select("block", "low", "high", "labels", chunk("block", self.zone_chunks).alias("zones")).withColumn("chunk", every(self.chunks))
        return left.groupBy("chunk", "zones").cogroup(right.groupBy("chunk", "zones")).applyInPandas(lambda a, b: route(a, b), schema)

    def read(self, name: str, asked: DataFrame, search) -> DataFrame:
        """``search(anchors, block)`` of every block with the anchors that ask for it, those of a hot block in several groups."""
        asked = self.tables.keep(f"asked-{name}", asked)
        again = asked.sparkSession.read.schema(asked.schema).parquet(self.tables.folders[f"asked-{name}"])
        wanted = again.select("block", "salt").distinct()
        held = self.blocks.join(wanted, "block").select("block", "salt", "width", "ids", "codes", "vectors")
        found = asked.groupBy("block", "salt").cogroup(held.groupBy("block", "salt")).applyInPandas(lambda a, b: search(a, b), FOUND)
        found = self.tables.keep(name, found)
        self.tables.drop(f"asked-{name}")
        return found


def _zones(zones: pd.DataFrame, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks, low and high edges, and whether a block has an anchor's label or another one (anchors x blocks)."""
    low, high = _stack(zones["low"].to_numpy()), _stack(zones["high"].to_numpy())
    kept = [set(x.tolist()) for x in zones["labels"]]
    own = np.array([[label in held for held in kept] for label in labels.tolist()], bool).reshape(len(labels), len(kept))
    several = np.array([len(held) for held in kept])[None, :] > own
    return zones["block"].to_numpy(), low, high, own, several


def _box_intervals(vectors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(vectors.shape[1], low.shape[1])
    return intervals(_wider(vectors, width), _wider(low, width), _wider(high, width))


def best_blocks(anchors: pd.DataFrame, zones: pd.DataFrame) -> pd.DataFrame:
    """Per anchor the block with its label and the one with another label that have the greatest upper end."""
    columns = {"id": [], "kind": [], "reach": [], "block": []}
    if len(anchors) and len(zones):
        ids, labels, vectors = _asked(anchors)
        blocks, low, high, own, other = _zones(zones, labels)
        reach = _box_intervals(vectors, low, high)[1]
        for kind, allowed in (("own", own), ("other", other)):
            upper = np.where(allowed, reach, -np.inf)
            at = upper.argmax(1)
            some = np.flatnonzero(allowed.any(1))
            columns["id"] += ids[some].tolist()
            columns["kind"] += [kind] * len(some)
            columns["reach"] += upper[some, at[some]].tolist()
            columns["block"] += blocks[at[some]].tolist()
    return pd.DataFrame(columns, dtype=None if columns["id"] else object)


def _visits(anchors: pd.DataFrame, blocks: np.ndarray, needed: np.ndarray) -> pd.DataFrame:
    at, which = np.nonzero(needed & (blocks[None, :] != anchors["first"].fillna(-1).to_numpy(np.int64)[:, None]))
    return anchors.iloc[at].assign(block=blocks[which])[list(NO_VISITS.columns)] if len(at) else NO_VISITS


def blocks_for_positives(anchors: pd.DataFrame, zones: pd.DataFrame) -> pd.DataFrame:
    """Blocks with the anchor's label that can reach its floor, but for the one read first."""
    if not len(anchors) or not len(zones):
        return NO_VISITS
    _, labels, vectors = _asked(anchors)
    blocks, low, high, own, _ = _zones(zones, labels)
    floor = np.array([-np.inf if pd.isna(x) else float(x) for x in anchors["floor"]])
    reach = _box_intervals(vectors, low, high)[1]
    return _visits(anchors, blocks, own & (reach * (1 + np.sign(reach) * 1e-12) >= floor[:, None]))


def blocks_for_windows(anchors: pd.DataFrame, zones: pd.DataFrame) -> pd.DataFrame:
    """Blocks with another label whose interval meets one of the anchor's windows above what was found in it."""
    if not len(anchors) or not len(zones):
        return NO_VISITS
    _, labels, vectors = _asked(anchors)
    blocks, low, high, _, other = _zones(zones, labels)
    least, most = _box_intervals(vectors, low, high)
    _, top, floor = _windows(anchors["wins"])
    open_ = (floor <= top)[:, :, None]
    slack = 1e-12 * np.maximum(np.abs(least), np.abs(most))[:, None, :]
    meets = open_ & (most[:, None, :] + slack >= floor[:, :, None].astype(float)) & (least[:, None, :] - slack <= top[:, :, None].astype(float))
    return _visits(anchors, blocks, other & meets.any(1))


def mine(rows: DataFrame, anchors: DataFrame, tables: Tables, **sizes: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Both sides have id, label and numbers (array of long). An anchor's positives are its first 5 other rows of its label by
    inner product, ties to the smaller id; for each of them come the first 3 rows of other labels whose score lies in 50 to
    95 hundredths of the positive's. All, if there are fewer. A null id, label or numbers takes no part. Rows alike in all
    three count once; an anchor id that comes several times stands for its least vector; an anchor never meets rows with
    its own id. Vectors of unequal length are compared as if filled with zeros. Empty tables give none; further columns are
    not read. ``sizes`` are those of Miner.
    """
    miner = Miner(rows, anchors, tables, **sizes)
    salted = miner.anchors.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(miner.salts)))
    no_wins, no_floor = F.lit(None).cast(ASKED.split("wins ")[1]), F.lit(None).cast("bigint")
    best = miner.against_zones(miner.anchors, best_blocks, "id bigint, kind string, reach double, block bigint")
    best = tables.keep("best", best.groupBy("id", "kind").agg(F.max(F.struct("reach", "block"))["block"].alias("first")))
    asked_columns = ["block", "salt", "id", "label", "numbers", "floor", "wins"]

    own = salted.join(best.where("kind = 'own'").select("id", "first"), "id", "left")
    start = own.where("first is not null").select(F.col("first").alias("block"), "salt", "id", "label", "numbers", no_floor.alias("floor"), no_wins.alias("wins"))
    found = miner.read("positives-first", start, positives_in)
    floors = found.groupBy("id").agg(F.when(F.count("*") >= POSITIVES, F.min("score")).alias("floor"))
    routed = miner.against_zones(own.join(floors, "id", "left").withColumn("wins", no_wins), blocks_for_positives, ASKED)
    found = found.unionByName(miner.read("positives-rest", routed, positives_in))
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("place", place).where(F.col("place") <= POSITIVES)
    positives = tables.keep("positives", found.select("id", "place", F.col("vec_id").alias("positive_id"), "score"))

    other = salted.join(best.where("kind = 'other'").select("id", "first"), "id", "left")
    wins = lambda df: F.collect_list(F.struct("place", "positive_id", "score", df)).alias("wins")
    open_ = other.join(positives.groupBy("id").agg(wins(no_floor.alias("floor"))), "id").withColumn("floor", no_floor)
    start = open_.where("first is not null").withColumn("block", F.col("first")).select(asked_columns)
    near = miner.read("negatives-first", start, negatives_in)
    third = near.groupBy("id", "place").agg(F.when(F.count("*") >= NEGATIVES, F.min("score")).alias("floor"))
    raised = positives.join(third, ["id", "place"], "left").groupBy("id").agg(wins(F.col("floor")))
    routed = miner.against_zones(other.join(raised, "id").withColumn("floor", no_floor), blocks_for_windows, ASKED)
    near = near.unionByName(miner.read("negatives-rest", routed, negatives_in))
    rank = F.row_number().over(W.partitionBy("id", "place").orderBy(F.desc("score"), "vec_id"))
    chosen = near.withColumn("rank", rank).where(F.col("rank") <= NEGATIVES).select("id", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return chosen.join(positives, ["id", "place"]).select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")


SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS numbers FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_dot_product(a.numbers, v.numbers) AS BIGINT) AS score
  FROM v AS a JOIN v ON a.vec_id % 50 = 0 AND a.vec_id <> v.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
