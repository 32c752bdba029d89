"""Quality scores and languages recomputed in plain Python and single matrices."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from shoplens.llm import language, quality
from shoplens.llm.common import Tables, scatter

FOLDER = "/root/testdata/sf0.001"
STOPS, MARKS = b".,;:'\"-()", b"!?#$%&*@^~<>=+_/\\[]{}`"


def plain_statistics(text):
    """The 18 numbers of one text, counted byte by byte and word by word."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * quality.STATISTICS
    lower, upper = sum(97 <= b < 123 for b in raw), sum(65 <= b < 91 for b in raw)
    digits, newlines, blanks = sum(48 <= b < 58 for b in raw), raw.count(b"\n"), sum(b in (9, 11, 12, 13, 32) for b in raw)
    stops, marks, bars = sum(b in STOPS for b in raw), sum(b in MARKS for b in raw), raw.count(b"|")
    inner, leads = sum(128 <= b < 192 for b in raw), sum(b >= 192 for b in raw)
    other = len(raw) - lower - upper - digits - newlines - blanks - stops - marks - bars - inner - leads
    chars, letters = max(len(raw) - inner, 1), max(lower + upper + leads, 1)
    words = raw.split()
    n, sizes = len(words), [len(w) for w in words]
    many, small = max(n, 1), [w.lower() for w in words]
    mean = sum(sizes) / many
    spread = math.sqrt(max(sum(x * x for x in sizes) / many - mean**2, 0))
    pairs = list(zip(small, small[1:]))
    return [
        math.log1p(n), math.log1p(mean), math.log1p(spread), upper / letters, digits / chars, (blanks + newlines) / chars, stops / chars, marks / chars, bars / chars,
        leads / letters, other / chars, newlines / many, len(set(small)) / many, len(set(pairs)) / max(n - 1, 1), sum(a == b for a, b in pairs) / many,
        sum(w[-1] in MARKS for w in words) / many, sum(w[-1] in STOPS for w in words) / many, sum(65 <= w[0] < 91 for w in words) / many,
    ]


def test_statistics_byte_by_byte(odd, odd_rows):
    found = sorted(((r.doc_id, [round(x, 9) for x in r.statistics]) for r in quality.measured(odd).collect()), key=repr)
    assert found == sorted(((r[0], [round(x, 9) for x in plain_statistics(r[1])]) for r in odd_rows), key=repr)


def test_scores_from_one_matrix(spark):
    """Normal equations, pooled means and interpolation over all rows at once."""
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    values = {i: np.array(plain_statistics(t)) for i, t in texts.items()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 3
    known = {r.doc_id: float(r.quality) for r in labels.collect() if r.quality in (0, 1) and fold(r.doc_id) != 1 and r.doc_id in values}
    learned = sorted(known)
    matrix, y = np.stack([values[i] for i in learned]), np.array([known[i] for i in learned])
    scale = matrix.std(0)
    draw = np.random.default_rng(6)
    directions, phases = draw.normal(size=(quality.STATISTICS, quality.FEATURES)) / quality.WIDTH, draw.uniform(0, 2 * np.pi, quality.FEATURES)
    wave = lambda m: np.hstack([np.cos((m - matrix.mean(0)) / np.where(scale > 1e-9, scale, 1.0) @ directions + phases) * np.sqrt(2 / quality.FEATURES), np.ones((len(m), 1))])
    fits = np.array([fold(i) == 0 for i in learned])
    phi = wave(matrix[fits])
    gram = phi.T @ phi
    ridge = quality.RIDGE * fits.sum() / quality.FEATURES * np.eye(len(gram))
    ridge[-1, -1] = 1e-9
    weights = np.linalg.solve(gram + ridge, phi.T @ y[fits])
    raw = np.clip(wave(matrix[~fits]) @ weights, quality.LOW, quality.HIGH)
    bins = ((raw - quality.LOW) / (quality.HIGH - quality.LOW) * (quality.BINS - 1)).astype(int)
    held = [(0.0, 1.0), *[(y[~fits][bins == b].sum(), float((bins == b).sum())) for b in np.unique(bins)], (1.0, 1.0)]
    pooled = lambda a, b: sum(s for s, _ in held[a : b + 1]) / sum(n for _, n in held[a : b + 1])
    levels = [max(min(pooled(a, b) for b in range(i, len(held))) for a in range(i + 1)) for i in range(len(held))]
    at = [quality.LOW + (b + 0.5) * (quality.HIGH - quality.LOW) / (quality.BINS - 1) for b in np.unique(bins)]
    ids = sorted(values)
    wanted = np.interp(wave(np.stack([values[i] for i in ids])) @ weights, [quality.LOW, *at, quality.HIGH], levels)
    found = {r.doc_id: r.score for r in quality.scored(docs, labels, Tables("test")).collect()}
    assert np.abs(wanted - np.array([found[i] for i in ids])).max() < 1e-5


def plain_grams(text):
    """Buckets of the n-grams of one text: every run of other bytes after a letter is one space."""
    lowered = pc.utf8_lower(pa.scalar(text or "")).as_py().encode()
    out = bytearray()
    for b in lowered:
        letter = 97 <= b < 123 or b >= 128
        if letter:
            out.append(b)
        elif out and out[-1] != 32:
            out.append(32)
    values = [int.from_bytes(bytes([size]) + bytes(out[i : i + size]), "big") for size in language.SIZES for i in range(len(out) - size + 1)]
    return Counter((scatter(np.array(values, np.uint64)) & np.uint64(language.BUCKETS - 1)).tolist()) if values else Counter()


def test_grams_do_not_depend_on_the_texts_around(odd_rows):
    texts = [r[1] for r in odd_rows] + ["ab", "!cd", "", "e f", " g"]
    row, bucket, n = language.grams(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"]))
    assert n == len(texts)
    for i, text in enumerate(texts):
        assert Counter(bucket[row == i].tolist()) == plain_grams(text)


def test_languages_from_plain_counts(spark):
    """Odds, bit weights, losses and the least one, from Python counters."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    counted = {r.doc_id: plain_grams(r.text) for r in rows}
    learned = [r for r in rows if r.lang and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    names = sorted({r.lang for r in learned})
    shares = {}
    for name in names:
        total = sum((counted[r.doc_id] for r in learned if r.lang == name), Counter())
        whole = sum(total.values()) + language.SMOOTHING * language.BUCKETS
        shares[name] = np.array([(total[b] + language.SMOOTHING) / whole for b in range(language.BUCKETS)])
    splits = [s for s in itertools.product((-1, 1), repeat=len(names)) if s[0] == 1 and -1 in s]
    odds = [np.log(np.mean([shares[n] for n, side in zip(names, s) if side > 0], 0) / np.mean([shares[n] for n, side in zip(names, s) if side < 0], 0)) for s in splits]
    margin = {i: [sum(c * o[b] for b, c in g.items()) / max(sum(g.values()), 1) for o in odds] for i, g in counted.items()}
    weights = []
    for bit, split in enumerate(splits):
        good = sum(margin[r.doc_id][bit] * split[names.index(r.lang)] > 0 for r in learned)
        rate = (good + 1) / (len(learned) + 2)
        weights.append(max(math.log(rate / (1 - rate)), 1e-3))
    found = {r.doc_id: r for r in language.identify(docs, language.fit(docs)).collect()}
    for r in rows:
        losses = [sum(w * math.log1p(math.exp(-language.SHARPNESS * m * s[place])) for w, m, s in zip(weights, margin[r.doc_id], splits)) / sum(weights) for place in range(len(names))]
        chances = [math.exp(-language.SHARPNESS * (x - min(losses))) for x in losses]
        best = losses.index(min(losses))
        if any(c.isalpha() for c in r.text or ""):
            assert found[r.doc_id].lang_pred == names[best] and abs(found[r.doc_id].score - chances[best] / sum(chances)) < 1e-6
        else:
            assert (found[r.doc_id].lang_pred, found[r.doc_id].score) == ("und", 0.0)
