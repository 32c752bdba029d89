"""What several operators share: written intermediates, UTF-8 buffers in Arrow batches, hashed words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from shoplens.sources.sinks import run_folder

CHUNK_BYTES = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Tables:
    """Intermediate results written as Parquet below the shared folder, so that a lost executor costs no recomputation."""

    def __init__(self, purpose: str):
        self.purpose = purpose
        self.folders: dict[str, str] = {}
        self.spark = None

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        self.spark = df.sparkSession
        folder = run_folder(self.spark, f"{self.purpose}-{name}")
        df.write.parquet(folder)
        self.folders[name] = folder
        return self.spark.read.schema(df.schema).parquet(folder)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads; a repeat of the same name keeps only the newest."""
        for name in names or list(self.folders):
            folder = self.folders.pop(name, None)
            if folder:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with at most ``limit`` bytes of text, or one longer row, so that work arrays stay small."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the n+1 borders of its rows; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, borders, data = column.buffers()
    offsets = np.frombuffer(borders, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def scatter(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size, base = 1 << max(20, (n - 1).bit_length()), int(ODD)
        for name, factor in (("up", base), ("down", pow(base, -1, 1 << 64))):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, start and end of every maximal run of bytes that are not ASCII white space."""
    inside = ~SPACES[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | border[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of every word: a difference of prefix sums, shifted to a common origin."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return scatter((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
