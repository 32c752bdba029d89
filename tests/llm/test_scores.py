"""Token counts, quality, language, licences and mixes."""

import math
import random
import re
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shoplens.llm import language, licenses, mixing, quality, tokens
from shoplens.llm.common import Tables

FOLDER = "/root/testdata/sf0.01"
PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def test_token_counts_as_the_library(odd, odd_rows, nothing, spark):
    library = Tokenizer.from_file(PATH)
    extra = [(900, "a<|endoftext|>b <|startoftext|>\x1cX don't I'LL 123 ́x ΣΑΣ. İs t \t\v\f é", *[None] * 6), (901, "ab" * 40000, *[None] * 6)]
    both = odd.unionByName(spark.createDataFrame(extra, odd.schema))
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    expected = sorted(((r[0], len((r[1] or "").encode()), n := count(r[1]), n > 100) for r in [*odd_rows, *extra]), key=repr)
    assert sorted(map(tuple, tokens.token_counts(both, PATH, limit=100).collect()), key=repr) == expected
    assert tokens.token_counts(nothing, PATH).collect() == []


def test_quality_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.scored(docs, labels, Tables("test")).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.97
    assert min(sum(r.predicted == r.quality for r in held if r.quality == q) / max(1, sum(r.quality == q for r in held)) for q in (0, 1)) > 0.9


def test_quality_of_odd_tables(odd, odd_rows, nothing, spark):
    labels = spark.createDataFrame([(i, q, "x") for i in range(0, 60) for q in ([0, 1] if i % 7 == 0 else [i % 2])] + [(3, None, ""), (None, 1, ""), (9999, 1, "")], "doc_id long, quality int, text string")
    rows = quality.scored(odd, labels, Tables("test")).collect()
    assert sorted((r.doc_id for r in rows), key=repr) == sorted((r[0] for r in odd_rows), key=repr) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.scored(odd, labels.where("quality = 1"), Tables("test")).collect()} == {1.0}
    assert {r.score for r in quality.scored(odd, labels.limit(0), Tables("test")).collect()} == {0.5}
    assert quality.scored(nothing, labels, Tables("test")).collect() == []
    assert quality.accepted(odd, labels.where("quality = 1"), Tables("test")).count() == len(odd_rows)
    assert quality.accepted(odd, labels.where("quality = 0"), Tables("test")).count() == 0


def test_isotonic_means_never_fall():
    draw = np.random.default_rng(1)
    counts = draw.integers(1, 9, 60).astype(float)
    sums = np.array([draw.binomial(int(n), i / 60) for i, n in enumerate(counts)], float)
    fitted = quality.isotonic(sums, counts)
    assert (np.diff(fitted) >= -1e-12).all() and math.isclose((fitted * counts).sum(), sums.sum())


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = language.identify(docs, language.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98 and all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_tables(odd, odd_rows, nothing, spark):
    learned = language.fit(odd)
    rows = language.identify(odd, learned).collect()
    assert len(rows) == len(odd_rows) and {r.lang_pred for r in rows} <= {"en", "fr", "und"}
    marks = spark.createDataFrame([(1, "123 !?"), (2, None), (3, ""), (4, "Ж"), (5, "字" * 9)], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in sorted(language.identify(marks, learned).collect())] == [True, True, True, False, False]
    assert {r.lang_pred for r in language.identify(odd, language.fit(nothing)).collect()} == {"und"}
    assert {r.score for r in language.identify(odd, language.fit(odd.where("lang = 'en'"))).collect() if r.lang_pred == "en"} == {1.0}
    assert language.identify(nothing, learned).collect() == []


@pytest.mark.parametrize("n", [2, 5, 7, 20])
def test_codewords_differ(n):
    code = language.codewords(n)
    gaps = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
    assert len(code) == n and min(gaps) >= (1 if n == 2 else code.shape[1] // 4)


def test_licences_as_brute_force(odd, odd_rows, nothing, spark):
    lines = [
        "Released under the MIT License.", "released UNDER mit-license!", "Apache\nLicense", "the Apache License, Version 2.0 license", "GNU General Public  License mit license",
        "this source code form is subject to the terms of the mozilla public license v 2 0", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and documentation",
        "Licensed under CC BY-NC 4.0.", "mit Kicense mit lİcense mit licenseé", "license mit", "the general public", "mit license " * 3000,
        "this source code form is subject to the\nterms of the Mozilla Public License, v 2 0", "Permission is hereby granted,\nfree of charge, to any person\nobtaining a copy of this software and\nassociated files", "licensed under\nother words here that are many cc by nc 4 0",
    ]
    rows = [*odd_rows, *[(800 + i, t, *[None] * 6) for i, t in enumerate(lines)]]
    found = sorted((tuple(r) for r in licenses.scan(spark.createDataFrame(rows, odd.schema), Tables("test")).collect()), key=repr)
    sets = [(label, set(t.split())) for label, ts in licenses.TEMPLATES.items() for t in ts]
    lengths = [len(t.split()) for ts in licenses.TEMPLATES.values() for t in ts]
    split = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    expected = []
    for row in rows:
        words = split(row[1])
        at = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if tuple(words[i : i + len(phrase)]) == phrase]
        base = {label for _, label in at}
        shares = [(len(s & set(split(line))) / len(s), label) for line in (row[1] or "").split("\n") for label, s in sets]
        if "\n" in (row[1] or ""):  # a notice may be wrapped over lines: every run of as many words as the template has
            shares += [(len(s & set(words[i : i + n])) / len(s), label) for (label, s), n in zip(sets, lengths) for i in range(len(words))]
        good = [x for x in shares if x[0] >= licenses.THRESHOLD - 1e-12]
        labels = sorted(base | {label for _, label in good})
        score = 1.0 if at else max([x[0] for x in good], default=0.0)
        places = [i for i, _ in at]
        expected.append((row[0], len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(labels), score))
    assert found == sorted(expected, key=repr)
    assert {"mpl", "cc-by-nc"} <= {x for r in found for x in r[6].split(",")}
    assert licenses.scan(nothing, Tables("test")).collect() == []


def test_licences_wrapped_over_lines(spark):
    every = [(label, t) for label, ts in licenses.TEMPLATES.items() for t in ts]
    wraps = [textwrap.fill("x" * lead + " " + t + " and so on", 70, initial_indent="# ", subsequent_indent="# ") for lead in (5, 55) for _, t in every]
    far = "redistribution and use in source and binary forms with or without\n" + "other words " * 30 + "\nmodification are permitted provided that the following conditions are met"
    rows = [(i, t) for i, t in enumerate([*wraps, far])]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), Tables("test")).collect()}
    assert all(label in found[i].labels.split(",") and found[i].score == 1.0 for i, (label, _) in enumerate(every * 2))
    assert (found[len(wraps)].labels, found[len(wraps)].score) == ("", 0.0)


def test_mix_keeps_to_its_targets(odd, odd_rows, nothing, spark):
    mixed = mixing.mix(odd)
    assert mixed.columns == [c for c in odd.columns if c != "size"] + ["size", "source_size", "target", "copies", "taken"]
    rows = mixed.collect()
    assert len(rows) == len(odd_rows) and sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(odd.repartition(5)).collect()))
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(r.size for r in rows if r.source == s) for s in names}
    weights = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        level = left / sum(weights[s] for s in free)
        full = {s for s in free if level * weights[s] > 3 * sizes[s]}
        if not full:
            target |= {s: level * weights[s] for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3 * sizes[s] for s in full)
        free -= full
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source]) and r.taken == r.copies * r.size <= 3 * r.size
        assert abs(r.copies - r.target / r.source_size) < 1
    for s in names:
        most = max(r.size for r in rows if r.source == s)
        assert abs(sum(r.taken for r in rows if r.source == s) - target[s]) <= most
    assert mixing.repeat_rows(mixed).count() == sum(r.copies for r in rows)
    assert mixing.mix(nothing).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0, 0.0, 0)] * 3


def test_a_mix_of_many_rows_comes_near(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(1, 300), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(4000)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg({"target": "max", "taken": "sum"}).collect()
    assert all(abs(t - m) < 400 for _, t, m in (sorted(r.asDict().items()) and (r[0], r["sum(taken)"], r["max(target)"]) for r in mixed))
