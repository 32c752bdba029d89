"""A quality classifier: document statistics, random Fourier features, ridge scores, isotonic calibration.

Statistics are sums over the bytes and words of whole texts, one short vector per document, written once. A fixed random
cosine map of the standardised statistics approximates a Gaussian kernel; every partition sums its normal equations, and
the driver solves one small system. Held back labelled rows, counted in bins of the raw score, give the calibration.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import LOWER, Tables, byte_slices, scatter, utf8, word_hashes, words

FEATURES = 256
WIDTH = 4.0
RIDGE = 1e-3
BINS = 1000
LOW, HIGH = -0.5, 1.5
STATISTICS = 18


def _kinds() -> np.ndarray:
    """Class of each byte: other 0, lower 1, upper 2, digit 3, space 4, newline 5, stop 6, mark 7, bar 8, continuation 9, lead 10."""
    kinds = np.zeros(256, np.uint8)
    kinds[97:123], kinds[65:91], kinds[48:58] = 1, 2, 3
    kinds[[9, 11, 12, 13, 32]], kinds[10] = 4, 5
    kinds[[ord(c) for c in ".,;:'\"-()"]] = 6
    kinds[[ord(c) for c in "!?#$%&*@^~<>=+_/\\[]{}`"]] = 7
    kinds[ord("|")] = 8
    kinds[128:192], kinds[192:] = 9, 10
    return kinds


KINDS = _kinds()


def _per_row(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, values, n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """STATISTICS numbers per text; an empty text has zeros."""
    n, size = len(offsets) - 1, np.diff(offsets)
    kinds = KINDS[data]
    counts = np.zeros((11, n))
    filled = np.flatnonzero(size)
    if len(filled):
        for kind in range(11):
            counts[kind, filled] = np.add.reduceat(kinds == kind, offsets[:-1][filled], dtype=np.int64)
    chars = np.maximum(size - counts[9], 1)
    doc, starts, ends = words(data, offsets)
    hashes = word_hashes(LOWER[data], starts, ends)
    length = (ends - starts).astype(float)
    n_words = np.bincount(doc, minlength=n).astype(float)
    many = np.maximum(n_words, 1)
    same_doc = doc[1:] == doc[:-1]
    repeats = _per_row(doc[1:], (same_doc & (hashes[1:] == hashes[:-1])).astype(float), n)

    def distinct(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        keys = np.sort((rows.astype(np.uint64) << np.uint64(40)) | (values >> np.uint64(24)))
        first = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
        return np.bincount((keys[first] >> np.uint64(40)).astype(np.int64), minlength=n)

    pairs = scatter(hashes[:-1] * np.uint64(3) + hashes[1:])[same_doc]
    last = KINDS[data[ends - 1]] if len(ends) else np.zeros(0, np.uint8)
    first = KINDS[data[starts]] if len(starts) else np.zeros(0, np.uint8)
    letters = np.maximum(counts[1] + counts[2] + counts[10], 1)
    mean = _per_row(doc, length, n) / many
    spread = np.sqrt(np.maximum(_per_row(doc, length**2, n) / many - mean**2, 0))
    columns = [
        np.log1p(n_words), np.log1p(mean), np.log1p(spread), counts[2] / letters, counts[3] / chars, (counts[4] + counts[5]) / chars,
        counts[6] / chars, counts[7] / chars, counts[8] / chars, counts[10] / letters, counts[0] / chars, counts[5] / many,
        distinct(doc, hashes) / many, distinct(doc[1:][same_doc], pairs) / np.maximum(n_words - 1, 1), repeats / many,
        _per_row(doc, (last == 7).astype(float), n) / many, _per_row(doc, (last == 6).astype(float), n) / many,
        _per_row(doc, (first == 2).astype(float), n) / many,
    ]
    return np.where(size > 0, np.stack(columns), 0.0).T


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and statistics (array) of every row; only these two columns are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                values = statistics(*utf8(part["text"]))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), STATISTICS).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part["key"], flat], names=[key, "statistics"])

    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, f"`{key}` {chosen.schema['key'].dataType.simpleString()}, statistics array<double>")


@dataclass(frozen=True)
class Model:
    """centre, scale, directions, phases and weights make the raw score; borders and levels calibrate it."""

    centre: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    borders: np.ndarray
    levels: np.ndarray

    def features(self, values: np.ndarray) -> np.ndarray:
        """The random cosine map and a constant."""
        waves = np.cos(((values - self.centre) / self.scale) @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, np.ones((len(values), 1))])

    def raw(self, values: np.ndarray) -> np.ndarray:
        return self.features(values) @ self.weights

    def score(self, values: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(values), self.borders, self.levels)


def isotonic(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing means closest to sums / counts."""
    blocks: list[list[float]] = []
    for total, n in zip(sums, counts):
        blocks.append([total, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, n, width = blocks.pop()
            blocks[-1][0] += total
            blocks[-1][1] += n
            blocks[-1][2] += width
    return np.concatenate([np.full(int(width), total / n) for total, n, width in blocks]) if blocks else np.zeros(0)


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, STATISTICS))


def _sums(frame: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Normal equations: one matrix row per record and partition, added up per matrix row."""
    width = len(model.phases) + 1

    def partition(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width + 1))
        for part in parts:
            phi = model.features(_matrix(part["statistics"]))
            total[:, :width] += phi.T @ phi
            total[:, width] += phi.T @ part["y"].to_numpy()
        yield pd.DataFrame({"line": np.arange(width), "sums": list(total)})

    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, np.ndarray] = {}
        for part in parts:
            for line, sums in zip(part["line"], part["sums"]):
                found[line] = found[line] + sums if line in found else np.array(sums)
        if found:
            yield pd.DataFrame({"line": list(found), "sums": list(found.values())})

    schema = "line int, sums array<double>"
    rows = frame.mapInPandas(partition, schema).repartition("line").mapInPandas(merge, schema).collect()  # width rows
    total = np.zeros((width, width + 1))
    for row in rows:
        total[row["line"]] = row["sums"]
    return total[:, :width], total[:, width]


def fit(labelled: DataFrame, seed: int = 6) -> Model | float:
    """A model from rows with statistics, y (0 to 1) and calibrates; the mean label where there is nothing to tell apart.

    Every labelled row counts. The driver receives sums of bounded size: the statistics' moments, FEATURES + 1 rows of the
    normal equations and at most BINS bins.
    """
    moments = labelled.select(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.min("y").alias("low"), F.max("y").alias("high"), F.min("calibrates").alias("none"),
        *[f(F.get("statistics", F.lit(i))).alias(f"{name}{i}") for i in range(STATISTICS) for name, f in (("m", F.avg), ("s", F.stddev_pop))],
    ).first()
    if not moments["n"] or moments["low"] == moments["high"]:
        return 0.5 if not moments["n"] else float(moments["mean"])
    draw = np.random.default_rng(seed)
    scale = np.array([moments[f"s{i}"] for i in range(STATISTICS)])
    model = Model(
        np.array([moments[f"m{i}"] for i in range(STATISTICS)]), np.where(scale > 1e-9, scale, 1.0),
        draw.normal(size=(STATISTICS, FEATURES)) / WIDTH, draw.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0),
    )
    gram, right = _sums(labelled.where(~F.col("calibrates")), model)
    ridge = RIDGE * max(gram[-1, -1], 1.0) / FEATURES * np.eye(len(gram))
    ridge[-1, -1] = 1e-9
    model = Model(model.centre, model.scale, model.directions, model.phases, np.linalg.solve(gram + ridge, right), model.borders, model.levels)

    def binned(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            raw = np.clip(model.raw(_matrix(part["statistics"])), LOW, HIGH)
            yield pd.DataFrame({"bin": ((raw - LOW) / (HIGH - LOW) * (BINS - 1)).astype(int), "y": part["y"].to_numpy()})

    bins = labelled.where("calibrates").mapInPandas(binned, "bin int, y double").groupBy("bin")
    rows = sorted(tuple(r) for r in bins.agg(F.sum("y"), F.count("y")).collect())  # at most BINS rows
    at = np.array([LOW + (r[0] + 0.5) * (HIGH - LOW) / (BINS - 1) for r in rows])
    # One row of either label at the ends keeps scores of thin bins off 0 and 1.
    levels = isotonic(np.array([0.0, *[r[1] for r in rows], 1.0]), np.array([1.0, *[r[2] for r in rows], 1.0]))
    return Model(
        model.centre, model.scale, model.directions, model.phases, model.weights,
        np.concatenate(([LOW - 1e-9], at, [HIGH + 1e-9])), np.clip(levels + np.linspace(0, 1e-9, len(levels)), 0, 1),
    )


def remainder(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo a number of folds; null for a null key."""
    return (F.crc32(F.col(key).cast("string").cast("binary")) % parts).cast("int")


def _learned(stats: DataFrame, labels: DataFrame, tables: Tables, key: str, label: str) -> Model | float:
    known = labels.where(F.col(label).isin(0, 1) & (remainder(key, 3) != 1)).groupBy(F.col(key).alias("_key")).agg(F.avg(label).alias("y"))
    labelled = stats.join(known, F.col(key) == F.col("_key")).select("statistics", "y", (remainder(key, 3) == 2).alias("calibrates"))
    model = fit(tables.keep("labelled", labelled))
    tables.drop("labelled")
    return model


def scored(docs: DataFrame, labels: DataFrame, tables: Tables, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """key, held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 from 0.5) of every row.

    Held out are keys whose crc32 modulo 3 is 1; of the others remainder 0 fits the weights and 2 the calibration. Labels
    other than 0 and 1, null labels and labels without a document are not learned from; several labels of a key count as
    their mean; documents that repeat a key are all learned from. Null and empty texts have all-zero statistics and are
    scored like any other. A null key is never learned from and not held out. Without labels of both kinds every score is
    the mean label (0.5 with no labels). Columns other than key, text and label are not read.
    """
    stats = tables.keep("statistics", measured(docs, key, text))
    model = _learned(stats, labels, tables, key, label)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            values = _matrix(part["statistics"])
            score = np.full(len(values), model) if isinstance(model, float) else model.score(values)
            yield part.assign(score=score, predicted=(score >= 0.5).astype("int32")).drop(columns="statistics")

    rows = stats.select(F.col(key).alias("_key"), F.coalesce(remainder(key, 3) == 1, F.lit(False)).alias("held_out"), "statistics")
    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInPandas(run, f"_key {kind}, held_out boolean, score double, predicted int").withColumnRenamed("_key", key)


def accepted(docs: DataFrame, labels: DataFrame, tables: Tables, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The input's rows and columns without the rows that scored() predicts as 0; no row moves."""
    stats = tables.keep("statistics", measured(docs, key, text))
    model = _learned(stats, labels, tables, key, label)
    tables.drop("statistics")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, text):
                score = np.full(len(part), model) if isinstance(model, float) else model.score(statistics(*utf8(part[text])))
                yield part.filter(pa.array(score >= 0.5))

    return docs.mapInArrow(run, docs.schema)
