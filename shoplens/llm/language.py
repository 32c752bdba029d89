"""Language identification by error-correcting output codes over character n-grams.

Every language has a codeword; each bit is learned by a binary classifier whose evidence is the mean log odds of a text's
byte n-grams (lower case, letters only) between the languages with and without the bit. Decoding sums a logistic loss
per bit, weighted by how well the bit does on the training rows, and takes the codeword with the least loss.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import byte_slices, scatter, utf8
from shoplens.llm.quality import remainder

SIZES = (1, 2, 3)
BUCKETS = 1 << 13
SAMPLE = 2000
SMOOTHING = 0.5
SHARPNESS = 6.0
CLOSE = 0.2
SLICE = 1 << 18
UNKNOWN = "und"
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True


def codewords(n: int) -> np.ndarray:
    """n rows of -1 and 1. Up to 7 languages every split into two sides is a bit; beyond, fixed pseudo-random splits."""
    if n <= 7:
        splits = [s for s in product((-1, 1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits, np.float32).T.reshape(n, len(splits))
    width = 10 * int(np.ceil(np.log2(n)))
    best, apart = None, -1
    for seed in range(50):
        code = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (n, width))
        gram = code @ code.T - 2 * width * np.eye(n)
        if (distance := int((width - gram.max()) // 2)) > apart and (np.abs(code.sum(0)) < n).all():
            best, apart = code, distance
    return best


def grams(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and bucket of every n-gram of every text, and the number of rows. White space and marks become one space."""
    data, offsets = utf8(pc.utf8_lower(pc.fill_null(part["text"], "")))
    n = len(offsets) - 1
    letters = LETTER[data]
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    keep = letters.copy()
    keep[1:] |= letters[:-1] & (row[1:] == row[:-1])  # the first other byte after a letter ends the word
    text, row = np.where(letters, data, 32)[keep].astype(np.uint64), row[keep]
    rows, buckets = [], []
    for size in SIZES:
        if len(text) < size:
            break
        value = np.full(len(text) - size + 1, size, np.uint64)
        for i in range(size):
            value = (value << np.uint64(8)) | text[i : len(text) - size + 1 + i]
        inside = row[: len(value)] == row[size - 1 :]
        rows.append(row[: len(value)][inside])
        buckets.append((scatter(value[inside]) & np.uint64(BUCKETS - 1)).astype(np.int32))
    if not rows:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), n
    return np.concatenate(rows), np.concatenate(buckets), n


def has_letter(part: pa.RecordBatch) -> np.ndarray:
    """Whether a text has a letter of any script."""
    return pc.fill_null(pc.match_substring_regex(part["text"], r"\pL"), False).to_numpy(zero_copy_only=False)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray
    odds: np.ndarray
    weights: np.ndarray

    def margins(self, part: pa.RecordBatch) -> np.ndarray:
        """Mean log odds of every text and bit, 0 for texts without n-grams."""
        row, bucket, n = grams(part)
        hits = np.bincount(row, minlength=n)
        sums = np.stack([np.bincount(row, self.odds[bit][bucket], n) for bit in range(len(self.odds))], 1) if len(self.odds) else np.zeros((n, 0))
        return sums / np.maximum(hits, 1)[:, None]

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted mean logistic loss of every text and language."""
        loss = np.logaddexp(0, -SHARPNESS * margins[:, None, :] * self.code[None])
        return (loss * self.weights).sum(2) / max(self.weights.sum(), 1e-9)


def _training(docs: DataFrame, key: str, text: str, lang: str, sample: int) -> DataFrame:
    """At most about ``sample`` documents of each language, by key hash, from the rows that may be learned from."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (remainder(key, 4) != 2))
    rows = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = dict(rows.groupBy("lang").count().collect())  # one row per language
    if not counts:
        return rows.limit(0)
    share = F.create_map(*[F.lit(x) for name, n in sorted(counts.items()) for x in (name, int(min(1.0, sample / n) * 2**32))])
    return rows.where(F.pmod(F.xxhash64("key"), F.lit(2**32)) < share[F.col("lang")]).select("lang", "text")


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from at most about ``sample`` documents per language. The driver receives one count per language and n-gram
    bucket, and per bit the number of training rows that it gets right."""
    rows = _training(docs, key, text, lang, sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE):
                row, bucket, _ = grams(part)
                names = part["lang"].to_numpy(zero_copy_only=False)
                for name in set(names):
                    found = np.bincount(bucket[(names == name)[row]], minlength=BUCKETS)
                    sums[name] = sums.get(name, 0) + found
        for name, found in sums.items():
            used = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used)), pa.array(used), pa.array(found[used])], names=["lang", "bucket", "n"])

    found = rows.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(found["lang"]))
    totals = np.zeros((len(languages), BUCKETS))
    np.add.at(totals, (found["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int), found["bucket"].to_numpy(int)), found["n"].to_numpy())
    shares = (totals + SMOOTHING) / (totals.sum(1, keepdims=True) + SMOOTHING * BUCKETS)
    code = codewords(len(languages)) if len(languages) > 1 else np.ones((len(languages), 0), np.float32)
    odds = np.array([np.log(shares[bit > 0].mean(0) / shares[bit < 0].mean(0)) for bit in code.T]).reshape(code.shape[1], BUCKETS)
    model = Model(languages, code, odds, np.ones(code.shape[1]))
    if not len(odds):
        return model

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: i for i, x in enumerate(languages)}
        right, n = np.zeros(len(odds)), 0
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE):
                own = code[[place[x] for x in part["lang"].to_pylist()]]
                right += (model.margins(part) * own > 0).sum(0)
                n += len(own)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(odds)), pa.int32()), pa.array(right), pa.array([float(n)] * len(odds))], names=["bit", "good", "n"])

    rates = np.full(len(odds), 0.5)
    for bit, good, n in rows.mapInArrow(check, "bit int, good double, n double").groupBy("bit").agg(F.sum("good"), F.sum("n")).collect():
        rates[bit] = (good + 1) / (n + 2)
    return Model(languages, code, odds, np.maximum(np.log(rates / (1 - rates)), 1e-3))


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score (0 to 1) and ambiguous of every row.

    Texts that are null or have no letter get ``und`` with score 0, and so does everything when nothing was learned. With
    one language learned all others get it with score 1. ``ambiguous`` marks rows whose two best languages have about
    equal scores; equal losses go to the first language by name. Repeated and null keys are rows of their own; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE):
                known = has_letter(part) & bool(model.languages)
                if model.languages:
                    losses = model.losses(model.margins(part))
                    chance = np.exp(-SHARPNESS * (losses - losses.min(1, keepdims=True)))
                    chance /= chance.sum(1, keepdims=True)
                    best = losses.argmin(1)
                    score = chance.max(1)
                    second = np.sort(chance, 1)[:, -2] if len(model.languages) > 1 else np.zeros(len(best))
                    names = np.array(model.languages, object)[best]
                else:
                    names, score, second = np.full(len(known), UNKNOWN, object), np.zeros(len(known)), np.zeros(len(known))
                yield pa.RecordBatch.from_arrays(
                    [
                        part["key"], pa.array(np.where(known, names, UNKNOWN), pa.string()), pa.array(np.where(known, score, 0.0)),
                        pa.array(known & (score - second < CLOSE)),
                    ],
                    names=[key, "lang_pred", "score", "ambiguous"],
                )

    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, f"`{key}` {chosen.schema['key'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")
