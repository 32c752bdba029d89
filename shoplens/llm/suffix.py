"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash over WINDOW bytes marks triggers, which cut every text into phrases. A string of LENGTH bytes is written as
the part of its first phrase that reaches to its first trigger (a suffix of a dictionary phrase) and what follows it (the
parse). Equal strings have their first trigger at the same place, so they are looked for among the strings that share a
trigger, in bands of distances to it. All strings of a band share a middle; a middle that occurs once in the corpus, as
most do, ends the search. For the others the suffix order of what stands before the middle (dictionary) and the order of
what comes after it (parse) are built, with the common lengths of neighbours, and combined: strings are equal where both
orders put them in one class. The corpus order is thus made in shards of one middle each and never as one array.

Strings without a trigger, as in periodic text, are their own middle. Middles that many texts of one batch hold are
announced once per batch and looked at again in narrow bands, whose middles are longer; those that are still too frequent
for a task are settled string by string with grouped counts.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import Tables, _powers, byte_slices, scatter, utf8

LENGTH = 400
WINDOW = 16
PHRASE = 64
BAND = 128
NARROW = 16
FREQUENT = 256
PACK_BYTES = 4 << 20
ROWS = 20000
GROUP_ROWS = 100_000


class Bands:
    """Distances from a string's start to the end of its first trigger, cut into bands; the last kind has no trigger."""

    def __init__(self, length: int):
        starts = np.arange(0, length + 1, BAND) if length > WINDOW else np.zeros(0, np.int64)
        self.length = length
        self.low = np.maximum(starts, WINDOW)
        self.high = np.minimum(starts + BAND - 1, length)
        self.low, self.high = self.low[self.low <= self.high], self.high[: (self.low <= self.high).sum()]
        self.plain = len(self.low)
        # Narrower bands for frequent middles, numbered after the others; all_low and all_high go by number.
        self.narrow: list[list[tuple[int, int, int]]] = []
        low, high = [*self.low, 0], [*self.high, 0]
        for lowest, highest in zip(self.low.tolist(), self.high.tolist()):
            self.narrow.append([(len(low) + i, a, min(a + NARROW - 1, highest)) for i, a in enumerate(range(lowest, highest + 1, NARROW))])
            low += [x[1] for x in self.narrow[-1]]
            high += [x[2] for x in self.narrow[-1]]
        self.all_low, self.all_high = np.array(low), np.array(high)


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return sums, down


def trigger_ends(data: np.ndarray, offsets: np.ndarray, hashed: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where triggers end, and the row they lie in; a trigger never crosses texts."""
    if len(data) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums, down = hashed
    marks = scatter((sums[WINDOW:] - sums[:-WINDOW]) * down[: len(data) - WINDOW + 1])
    ends = np.flatnonzero(marks % np.uint64(PHRASE) == 0) + WINDOW
    row = np.searchsorted(offsets, ends - WINDOW, "right") - 1
    inside = ends <= offsets[row + 1]
    return ends[inside], row[inside]


def blocks(data: np.ndarray, offsets: np.ndarray, bands: Bands, hashed) -> dict[str, np.ndarray]:
    """Every band of every trigger that has a string in it, and every string without a trigger.

    row, at (trigger end, or start of the string), kind (band), low and high (its distances), begin and end of the middle."""
    length, last = bands.length, offsets[1:]
    ends, row = trigger_ends(data, offsets, hashed)
    before = np.full(len(ends), -1)
    if len(ends):
        same = row[1:] == row[:-1]
        before[1:][same] = ends[:-1][same]
    start = offsets[row]
    furthest = np.where(before >= 0, ends - before + WINDOW - 1, ends - start)  # the trigger before must not be inside
    nearest = ends + length - last[row]
    parts = {k: [] for k in ("row", "at", "kind", "low", "high", "begin", "end")}

    def add(row, at, kind, low, high, begin, end):
        for name, value in zip(parts, (row, at, np.full(len(row), kind), low, high, begin, end)):
            parts[name].append(value)

    for kind, (lowest, highest) in enumerate(zip(bands.low, bands.high)):
        low, high = np.maximum(nearest, lowest), np.minimum(furthest, highest)
        ok = low <= high
        add(row[ok], ends[ok], kind, low[ok], high[ok], ends[ok] - lowest, ends[ok] - highest + length)
    covered = np.zeros(len(data) + 1, np.int32)  # strings that hold a trigger or cross texts
    if len(ends):
        np.add.at(covered, np.maximum(ends - length, start), 1)
        np.add.at(covered, ends - WINDOW + 1, -1)
    edge = np.maximum(last - length + 1, offsets[:-1])
    np.add.at(covered, edge, 1)
    np.add.at(covered, last, -1)
    free = np.flatnonzero(np.cumsum(covered[:-1]) == 0)
    zero = np.zeros(len(free), np.int64)
    add(np.searchsorted(offsets, free, "right") - 1, free, bands.plain, zero, zero, free, free + length)
    return {name: np.concatenate(values) for name, values in parts.items()}


def _packed(node: np.ndarray, part: pa.RecordBatch, bands: Bands, frequent: int, shards: int) -> Iterator[tuple[int, bytes]]:
    """Blocks per shard: hashes of middles with text and place; frequent ones by name, their texts' places beside them."""
    data, offsets = utf8(part["text"])
    hashed = prefix_sums(data)
    found = blocks(data, offsets, bands, hashed)
    first = np.zeros(len(node), bool)
    first[np.unique(node, return_index=True)[1]] = True
    keep = first[found["row"]]
    row, at, kind, begin, end = (found[k][keep] for k in ("row", "at", "kind", "begin", "end"))
    sums, down = hashed
    middle = scatter((sums[end] - sums[begin]) * down[begin] + kind.astype(np.uint64))
    code = (at - offsets[row]) * 8 + kind
    names, which, held = np.unique(middle, return_inverse=True, return_counts=True)
    top = held[which] >= frequent
    shard = np.where(top, node[row] % shards, (middle % np.uint64(shards)).astype(np.int64))
    marks = names[held >= frequent]
    mark_shard = (marks % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    borders = np.searchsorted(shard[order], np.arange(shards + 1))
    for one in range(shards):
        mine, marked = order[borders[one] : borders[one + 1]], marks[mark_shard == one]
        if len(mine) or len(marked):
            mine_top = top[mine]
            here, owner = np.unique(row[mine], return_inverse=True)
            sent = ~mine_top
            yield one, pickle.dumps(
                (node[here], middle[mine][sent], owner[sent].astype(np.uint32), code[mine][sent].astype(np.uint32), owner[mine_top].astype(np.uint32), code[mine][mine_top].astype(np.uint32), marked), 5
            )


def _repeated(held: list[bytes]) -> pa.RecordBatch:
    """node, codes and hot codes of the places in a shard whose middle occurs again."""
    parts = [pickle.loads(b) for b in held]
    middle, marks = np.concatenate([p[1] for p in parts]), np.concatenate([p[6] for p in parts])
    node = np.concatenate([p[0][p[2]] for p in parts])
    code = np.concatenate([p[3] for p in parts])
    # Copies of a text in different batches count as one.
    order = np.lexsort((code, node, middle))
    middle, node, code = middle[order], node[order], code[order]
    new = np.ones(len(order), bool)
    new[1:] = (middle[1:] != middle[:-1]) | (node[1:] != node[:-1]) | (code[1:] != code[:-1])
    middle, node, code = middle[new], node[new], code[new]
    _, which, count = np.unique(middle, return_inverse=True, return_counts=True)
    hot = np.isin(middle, marks)
    again = (count[which] > 1) | hot if len(middle) else np.zeros(0, bool)
    node, code, hot = node[again], code[again], hot[again]
    node = np.concatenate([node, *[p[0][p[4]] for p in parts]])
    code = np.concatenate([code, *[p[5] for p in parts]]).astype(np.int64) * 2
    code[: len(hot)] += hot
    code[len(hot) :] += 1
    order = np.argsort(node, kind="stable")
    node, code = node[order], code[order]
    first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(node) else np.zeros(0, np.int64)
    stops = np.append(first[1:], len(node))
    return pa.RecordBatch.from_arrays([pa.array(node[first]), pa.array([code[a:b].tobytes() for a, b in zip(first, stops)], pa.binary())], names=["node", "codes"])


def repeated_places(docs: DataFrame, length: int, frequent: int, shards: int) -> DataFrame:
    """node and codes (packed: place, band, whether its middle is frequent) of texts with a middle that occurs again."""
    bands = Bands(length)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", PACK_BYTES):
                rows = list(_packed(part["node"].to_numpy(zero_copy_only=False), part, bands, frequent, shards))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "block"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for shard, block in zip(batch["shard"].to_pylist(), batch["block"].to_pylist()):
                if shard != now and held:
                    yield _repeated(held)
                    held = []
                now = shard
                held.append(block)
        if held:
            yield _repeated(held)

    packed = docs.select("node", "text").mapInArrow(pack, "shard int, block binary").repartition(shards, "shard").sortWithinPartitions("shard")
    found = packed.mapInArrow(finish, "node bigint, codes binary")
    return found.groupBy("node").agg(F.collect_list("codes").alias("codes"))


PLACE = "k1 bigint, k2 bigint, kind int, node bigint, at bigint, low int, high int, before binary, after binary"


def places(texts: DataFrame, length: int, hot: bool) -> DataFrame:
    """For texts (node, text, codes): each place with the digest of its middle and the bytes before and after it. Hot places
    are cut into narrow bands, whose longer middles reach beyond what made them frequent.

    Strings without a trigger that stand twice in a slice of texts, as in periodic text, are repeated for certain: they give
    runs of covered bytes (kind -1, from ``at``, ``high`` bytes long), and one of each stands for them elsewhere."""
    bands = Bands(length)
    names = [x.split()[0] for x in PLACE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                data, offsets = utf8(part["text"])
                found = blocks(data, offsets, bands, prefix_sums(data))
                code = (found["at"] - offsets[found["row"]]) * 8 + found["kind"]
                rows: list[tuple] = []
                plain: dict[bytes, set[tuple[int, int]]] = defaultdict(set)
                order = np.argsort(found["row"], kind="stable")
                borders = np.searchsorted(found["row"][order], np.arange(len(part) + 1))
                raw = data.tobytes()
                for i, (node, codes) in enumerate(zip(part["node"].to_pylist(), part["codes"].to_pylist())):
                    wanted = np.unique(np.concatenate([np.frombuffer(c, np.int64) for c in codes]))
                    wanted = wanted[(wanted & 1) == int(hot)] >> 1
                    mine = order[borders[i] : borders[i + 1]]
                    mine = mine[np.isin(code[mine], wanted)]
                    base = int(offsets[i])
                    for at, kind, low, high in zip(*(found[k][mine].tolist() for k in ("at", "kind", "low", "high"))):
                        if kind == bands.plain:
                            plain[xxhash.xxh3_128_digest(raw[at : at + length])].add((node, at - base))
                            continue
                        cuts = bands.narrow[kind] if hot else [(kind, bands.all_low[kind], bands.all_high[kind])]
                        for number, lowest, highest in cuts:
                            near, far = max(low, lowest), min(high, highest)
                            if near <= far:
                                begin, end = at - lowest, at - highest + length
                                k = xxhash.xxh3_128_digest(raw[begin:end])
                                rows.append((k, number, node, at - base, near, far, raw[at - far : begin], raw[end : at - near + length]))
                rows += [(k, bands.plain, *min(where), 0, 0, b"", b"") for k, where in plain.items()]
                rows += [(b"\0" * 16, -1, node, start, 0, stop - start, b"", b"") for node, start, stop in _runs(plain.values(), length)]
                columns = list(zip(*rows)) if rows else [()] * 8
                keys = np.frombuffer(b"".join(columns[0]), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()),
                        pa.array(columns[4], pa.int32()), pa.array(columns[5], pa.int32()), pa.array(columns[6], pa.binary()), pa.array(columns[7], pa.binary()),
                    ],
                    names=names,
                )

    return texts.select("node", "text", "codes").mapInArrow(run, PLACE)


def _runs(places_: Iterable[set[tuple[int, int]]], length: int) -> Iterator[tuple[int, int, int]]:
    """node, start and stop of the bytes under strings with several places."""
    now = None
    for node, at in sorted(x for where in places_ if len(where) > 1 for x in where):
        if now and now[0] == node and at <= now[2]:
            now = (node, now[1], at + length)
            continue
        if now:
            yield now
        now = (node, at, at + length)
    if now:
        yield now


def _grid(strings: pa.Array, width: int, backwards: bool) -> np.ndarray:
    """Strings as rows of bytes, filled with zeros; backwards puts the last byte first."""
    data, offsets = utf8(strings)
    out, size = np.zeros((len(strings), width), np.uint8), np.diff(offsets)
    row = np.repeat(np.arange(len(strings)), size)
    place = np.arange(len(data)) - offsets[:-1][row]
    out[row, size[row] - 1 - place if backwards else place] = data
    return out


def _order(group: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in (group, bytes) order and the common length of each with the one before, -1 where the group changes."""
    wide = np.pad(grid, ((0, 0), (0, -grid.shape[1] % 8))).view(">u8").astype(np.uint64)
    order = np.lexsort((*wide.T[::-1], group))
    sorted_ = grid[order]
    common = np.full(len(order), -1)
    if len(order) > 1:
        differs = sorted_[1:] != sorted_[:-1]
        common[1:] = np.where(differs.any(1), differs.argmax(1), grid.shape[1])
        common[1:][group[order][1:] != group[order][:-1]] = -1
    return order, common


def equal_strings(group: np.ndarray, low: np.ndarray, high: np.ndarray, lowest: np.ndarray, highest: np.ndarray, before: pa.Array, after: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of every string that another place of the same group (one middle) has as well.

    A string at distance d takes d - lowest bytes before the middle and highest - d after it."""
    width = max(1, int((highest - lowest).max(initial=0)))
    left, right = _grid(before, width, True), _grid(after, width, False)
    (by_left, left_common), (by_right, right_common) = _order(group, left), _order(group, right)
    out_row, out_at = [], []
    left_class, right_class = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
    for taken in range(width + 1):
        left_class[by_left] = np.cumsum(left_common < taken)
        distance = lowest + taken
        rest = np.maximum(highest - distance, 0)
        # The rest's length differs between bands, so compare by each row's own rest.
        right_class[by_right] = np.cumsum(right_common < rest[by_right])
        valid = np.flatnonzero((low <= distance) & (distance <= high))
        if not len(valid):
            continue
        pair = left_class[valid] * (len(group) + 1) + right_class[valid]
        _, which, count = np.unique(pair, return_inverse=True, return_counts=True)
        twice = count[which] > 1
        out_row.append(valid[twice])
        out_at.append(distance[valid[twice]])
    none = np.zeros(0, np.int64)
    return np.concatenate(out_row or [none]), np.concatenate(out_at or [none])


def _covered(batch: pa.RecordBatch, bands: Bands) -> pa.RecordBatch:
    """node, start and stop of the bytes covered by equal strings, for whole groups of middles."""
    column = lambda name: batch[name].to_numpy(zero_copy_only=False)
    k1, k2, kind, node, at, low, high = (column(c) for c in ("k1", "k2", "kind", "node", "at", "low", "high"))
    group = np.zeros(len(k1), np.int64)
    group[1:] = np.cumsum((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (kind[1:] != kind[:-1]))
    lowest, highest = bands.all_low[kind], bands.all_high[kind]
    # A row that repeats another's key and text comes as often, and counts once.
    order = np.lexsort((at, node, group))
    once = np.ones(len(order), bool)
    once[1:] = (group[order][1:] != group[order][:-1]) | (node[order][1:] != node[order][:-1]) | (at[order][1:] != at[order][:-1])
    rows = order[once]
    rows = np.sort(rows[np.bincount(group[rows])[group[rows]] > 1])
    if not len(rows):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["node", "start", "stop"])
    picked = pa.array(rows)
    row, distance = equal_strings(group[rows], low[rows], high[rows], lowest[rows], highest[rows], batch["before"].take(picked), batch["after"].take(picked))
    row = rows[row]
    start = at[row] - distance
    order = np.lexsort((start, node[row]))
    row, start = row[order], start[order]
    new = np.ones(len(row), bool)
    new[1:] = (node[row[1:]] != node[row[:-1]]) | (start[1:] > start[:-1] + bands.length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return pa.RecordBatch.from_arrays([pa.array(node[row[first]]), pa.array(start[first]), pa.array(start[last] + bands.length)], names=["node", "start", "stop"])


def covered(found: DataFrame, length: int) -> DataFrame:
    """node, start, stop of repeated strings among places; a task holds the places of one middle, or ROWS of several."""
    bands = Bands(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if sum(map(len, held)) < ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            k1, k2 = (table[c].to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
            last = np.flatnonzero((k1 != k1[-1]) | (k2 != k2[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield _covered(table.slice(0, cut), bands)
            held = [table.slice(cut)]
        if held:
            yield _covered(pa.Table.from_batches(held).combine_chunks().to_batches()[0], bands)

    keys = ["k1", "k2"]
    return found.repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(run, "node bigint, start bigint, stop bigint")


def counted_strings(found: DataFrame, length: int) -> DataFrame:
    """covered() for places of middles too frequent for a task: every string by itself, counted after partial counts."""
    bands = Bands(length)
    lowest, highest = (F.get(F.array(*[F.lit(int(x)) for x in edge]), F.col("kind")) for edge in (bands.all_low, bands.all_high))
    rows = found.dropDuplicates(["k1", "k2", "kind", "node", "at"]).withColumns({"lowest": lowest, "highest": highest})
    each = rows.withColumn("distance", F.explode(F.sequence("low", "high")))
    left, right = F.col("distance") - F.col("lowest"), F.col("highest") - F.col("distance")
    each = each.select(
        "k1", "k2", "kind", "distance", "node", (F.col("at") - F.col("distance")).alias("start"),
        F.substr("before", F.octet_length("before") - left + 1, left).alias("before"), F.substr("after", F.lit(1), right).alias("after"),
    )
    string = ["k1", "k2", "kind", "distance", "before", "after"]
    twice = each.groupBy(*string).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return each.join(twice, string, "left_semi").select("node", "start", (F.col("start") + length).alias("stop"))


def _cut(texts: DataFrame) -> DataFrame:
    """Texts (node, text, spans) without their spans: kept bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for node, text, spans in zip(batch["node"].to_pylist(), batch["text"].to_pylist(), batch["spans"].to_pylist()):
                raw, kept, done, runs, removed = text.encode(), [], 0, 0, 0
                last = -1
                for span in spans:
                    start, stop = max(span["start"], done), span["stop"]
                    if span["start"] > last:
                        runs += 1
                    last = max(last, stop)
                    if stop > done:
                        kept.append(raw[done:start])
                        removed += stop - start
                        done = stop
                kept.append(raw[done:])
                left = b"".join(kept)
                rows.append((node, removed, runs, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
            columns = list(zip(*rows)) if rows else [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["node", "n_removed", "n_spans", "kept_sha256", "kept"])

    return texts.mapInArrow(run, "node bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string")


def _removed(docs: DataFrame, tables: Tables, length: int, frequent: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """One row per row (key, node, n_bytes, sha), and per text that loses bytes its n_removed, n_spans, kept_sha256 and kept."""
    shards = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chosen = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))
    rows = tables.keep("rows", chosen.select("key", "node", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")))
    long_rows = rows.where(F.col("n_bytes") >= length)
    one = long_rows.groupBy("node").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"))
    long_texts = chosen.where(F.octet_length("text") >= length)
    found = repeated_places(long_texts, length, frequent, shards)
    wanted = found.join(one.where("copies > 0"), "node").select(F.col("node").alias("node2"), F.col("key").alias("key2"), "codes", "copies")
    texts = long_texts.join(wanted, F.col("key").eqNullSafe(F.col("key2")) & (F.col("node") == F.col("node2"))).select("node", "text", "codes", "copies")
    texts = tables.keep("texts", texts)
    found = tables.keep("places", places(texts, length, False))
    hot = tables.keep("hot", places(texts, length, True))
    runs = found.unionByName(hot).where("kind < 0").select("node", F.col("at").alias("start"), (F.col("at") + F.col("high")).alias("stop"))
    found, hot = found.where("kind >= 0"), hot.where("kind >= 0")
    spans = runs.unionByName(covered(found, length))
    middle = ["k1", "k2", "kind"]
    again = hot.groupBy(*middle).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    spans = spans.unionByName(covered(hot.join(again.where(F.col("n") <= GROUP_ROWS), middle, "left_semi"), length))
    spans = spans.unionByName(counted_strings(hot.join(again.where(F.col("n") > GROUP_ROWS), middle, "left_semi"), length))
    spans = spans.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    lone = texts.where("copies = 1").select("node", "text").dropDuplicates(["node"])
    changed = tables.keep("changed", _cut(lone.join(spans, "node").select("node", "text", "spans")))
    copied = one.where("copies > 1").select("node", F.lit(True).alias("copied"))
    tables.drop("texts", "places", "hot")
    return rows, changed.join(copied, "node", "full")


def remove_repeats(
    docs: DataFrame, tables: Tables | None = None, length: int = LENGTH, frequent: int = FREQUENT, key: str = "doc_id", text: str = "text", kept: str | None = None
) -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_sha256 of every row, and what is left of its text in a column named ``kept``.

    Removed is each byte covered by a ``length``-byte string that also starts anywhere else. Null counts as empty; texts
    shorter than ``length`` keep everything, equal longer texts lose everything, and so do repeated rows. Null and repeated
    keys are rows of their own. An empty table gives no rows. Columns other than key and text are not read. Texts are told
    apart by 64-bit hashes, middles and strings by 128-bit ones. The digest is of the remaining bytes; in the column, where a
    cut falls inside a character, its other bytes are missing too.
    """
    rows, changed = _removed(docs, tables or Tables("repeats"), length, frequent, key, text)
    if kept:
        whole = F.coalesce(text, F.lit(""))
        rows = docs.select(F.col(key).alias("key"), F.xxhash64(whole).alias("node"), F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole, 256).alias("sha"), whole.alias("_text"))
    out = rows.join(changed if kept else changed.drop("kept"), "node", "left")
    left = [F.when(F.col("copied"), F.lit("")).otherwise(F.coalesce("kept", "_text")).alias(kept)] if kept else []
    return out.select(
        F.col("key").alias(key), "n_bytes", F.when(F.col("copied"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copied"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copied"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"), *left,
    )


def without_repeats(docs: DataFrame, tables: Tables | None = None, length: int = LENGTH, frequent: int = FREQUENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The input's rows and columns, texts without what remove_repeats() removes. Where a cut falls inside a character its
    other bytes go too. Null texts stay null."""
    _, changed = _removed(docs, tables or Tables("repeats"), length, frequent, key, text)
    changed = changed.select(F.col("node").alias("_node"), F.when(F.col("copied"), F.lit("")).otherwise(F.col("kept")).alias("_kept"))
    marked = docs.withColumn("_here", F.xxhash64(text))
    joined = marked.join(changed, F.col(text).isNotNull() & (F.octet_length(text) >= length) & (F.col("_here") == F.col("_node")), "left")
    return joined.select(*[F.coalesce("_kept", text).alias(text) if c == text else F.col(c) for c in docs.columns])
