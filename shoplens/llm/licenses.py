"""Licence scans: an exact set-similarity join between blocks of text and licence templates.

Blocks are the lines and, for notices wrapped over lines, every run of as many consecutive words as the template has.

A line contains a template when it holds at least ``threshold`` of the template's distinct words. Words are ordered by
how many lines hold them, rarest first. A line that reaches the required overlap a of a template with n words must hold
one of its n - a + 1 rarest words (prefix filter), must have at least a template words itself (length filter), and the
words that follow the shared one on both sides must suffice (positional filter). What passes is counted exactly.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import Tables

# Phrases that the scan must report wherever their words stand consecutively, and their labels.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
# Customary sentences of licence notices, by label.
TEMPLATES = {
    "apache": [
        "licensed under the apache license version 2 0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    ],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "cc-by-nc": ["licensed under cc by nc 4 0"],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    ],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    ],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
}
THRESHOLD = 0.8
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """Lower case for comparison with ASCII words. The two other letters whose lower case has ASCII letters, the Kelvin
    sign and the dotted capital I, first become another word character; words and their number stay."""
    return F.lower(F.replace(F.replace(text, F.lit("K"), F.lit("¿")), F.lit("İ"), F.lit("¿")))


def word_list(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), GAP), lambda w: w != "")


def places(found: Column, phrase: Sequence[str]) -> Column:
    """Where the phrase's words stand consecutively, words counted from 0."""

    def start(word: Column, at: Column) -> Column:
        same = word == phrase[0]
        for step, other in enumerate(phrase[1:], 1):
            same = same & (F.get(found, at + step) == other)
        return F.when(same, at.cast("long"))

    return F.filter(F.transform(found, start), lambda x: x.isNotNull())


def phrase_columns(docs: DataFrame, text: str) -> DataFrame:
    """n_words, n_base, first_word, last_word and _base (labels) of every row."""
    docs = docs.withColumn("n_words", F.regexp_count(text, F.lit(ANY_CASE_WORD)).cast("long"))
    last = sorted({p[-1] for p in PHRASES})
    mentions = F.col(text).rlike("(?i)" + "|".join(last))
    docs = docs.withColumn("_words", F.when(mentions, word_list(F.col(text))))
    docs = docs.withColumn("_places", F.when(mentions, F.array(*[places(F.col("_words"), p) for p in PHRASES])))
    every = F.flatten("_places")
    labels = F.array(*[F.when(F.size(F.get("_places", F.lit(i))) > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())])
    return docs.select(
        *[F.col(c) for c in docs.columns if c not in ("_words", "_places")],
        F.coalesce(F.when(mentions, F.size(every)), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(every).alias("first_word"), F.array_max(every).alias("last_word"),
        F.coalesce(F.when(mentions, F.array_compact(labels)), F.array().cast("array<string>")).alias("_base"),
    )


def contained_templates(
    lines: DataFrame, key: Sequence[str], tables: Tables, templates: Mapping[str, Sequence[str]] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """Key columns, label, template number, overlap and containment of every (line, template) at or above the threshold.

    ``lines`` has the key and ``line``. What reaches the driver is one count per template word.
    """
    sets = [(label, sorted(set(text.split()))) for label, texts in sorted(templates.items()) for text in texts]
    needed = [math.ceil(round(threshold * len(words), 9)) for _, words in sets]
    vocabulary = sorted({w for _, words in sets for w in words})
    known = F.array(*[F.lit(w) for w in vocabulary])
    hits = lines.select(*key, F.array_intersect(word_list(F.col("line")), known).alias("hits"))
    hits = tables.keep("lines", hits.where(F.size("hits") >= min(needed)))  # length filter
    counted = dict(hits.select(F.explode("hits").alias("word")).groupBy("word").count().collect())
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counted.get(w, 0), w)))}
    prefixes = []
    for number, ((label, words), least) in enumerate(zip(sets, needed)):
        ranked = sorted(words, key=order.__getitem__)
        prefixes += [(w, number, label, i, least, ranked) for i, w in enumerate(ranked[: len(words) - least + 1])]
    prefix = lines.sparkSession.createDataFrame(prefixes, "word string, template int, label string, at int, least int, words array<string>")
    ranks = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, order[w])])
    ranked = F.array_sort(F.transform("hits", lambda w: F.struct(ranks[w].alias("rank"), w.alias("word"))))
    tokens = hits.withColumn("_ranked", ranked).select(*key, "hits", F.posexplode("_ranked").alias("place", "token"))
    # The templates' prefixes are a parameter of the scan, a row per template and rare word, whatever the corpus.
    pairs = tokens.join(F.broadcast(prefix), tokens["token.word"] == prefix["word"])
    room = F.least(F.size("words") - F.col("at"), F.size("hits") - F.col("place"))
    pairs = pairs.where((F.size("hits") >= F.col("least")) & (room + F.least("at", "place") >= F.col("least")))
    overlap = F.size(F.array_intersect("hits", "words"))
    found = pairs.select(*key, "template", "label", overlap.alias("overlap"), (overlap / F.size("words")).alias("containment"), "least")
    return found.where(F.col("overlap") >= F.col("least")).drop("least").distinct()


def wrapped_templates(texts: DataFrame, tables: Tables, templates: Mapping[str, Sequence[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """For texts (_key, _row, _text, template): those where a run of as many words as the template has, over line ends too,
    contains it, with label and the greatest containment."""
    every = [(label, t.split()) for label, texts_ in sorted(templates.items()) for t in texts_]
    sets = [(i, label, len(t), sorted(set(t)), math.ceil(round(threshold * len(set(t)), 9))) for i, (label, t) in enumerate(every)]
    known = texts.sparkSession.createDataFrame(sets, "template int, label string, n int, words array<string>, least int")
    # A text of one line is its own block.
    texts = texts.where(F.contains("_text", F.lit("\n"))).join(F.broadcast(known), "template")
    placed = F.transform(word_list(F.col("_text")), lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    hits = tables.keep("hits", texts.select("_key", "_row", "label", "n", "least", F.size("words").alias("size"), F.filter(placed, lambda x: F.array_contains("words", x["word"])).alias("hits")))
    run = lambda h, i: F.filter(F.slice("hits", i + 1, F.col("n")), lambda g: g["at"] < h["at"] + F.col("n"))
    overlap = F.array_max(F.transform("hits", lambda h, i: F.size(F.array_distinct(F.transform(run(h, i), lambda g: g["word"])))))
    best = hits.withColumn("overlap", overlap).where(F.col("overlap") >= F.col("least"))
    return best.select("_key", "_row", "label", (F.col("overlap") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, tables: Tables | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    score is 1 where a base phrase stands, else the greatest containment of a matched template, else 0. Null texts count
    as empty: no words, no labels. Rows alike in key and text get equal results, each its own row; null keys are keys; an
    empty table gives none; other columns are not read.
    """
    tables = tables or Tables("licenses")
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("_text"))
    rows = rows.withColumn("_row", F.xxhash64("_key", "_text"))
    # What the whole text does not contain, no block of it does.
    whole = contained_templates(rows.select("_key", "_row", F.col("_text").alias("line")), ["_key", "_row"], tables)
    whole = tables.keep("whole", whole.select(F.col("_key").alias("_key1"), F.col("_row").alias("_row1"), "template"))
    same = (F.col("_row") == F.col("_row1")) & F.col("_key").eqNullSafe(F.col("_key1"))
    chosen = tables.keep("chosen", rows.join(whole, same).select("_key", "_row", "_text", "template"))
    lines = chosen.dropDuplicates(["_key", "_row"]).select("_key", "_row", F.explode(F.split("_text", "\n")).alias("line"))
    matches = contained_templates(lines, ["_key", "_row"], tables).select("_key", "_row", "label", "containment").unionByName(wrapped_templates(chosen, tables))
    matches = matches.groupBy(F.col("_key").alias("_key2"), F.col("_row").alias("_row2")).agg(
        F.collect_set("label").alias("_more"), F.max("containment").alias("_best")
    )
    base = phrase_columns(rows, "_text").drop("_text")
    joined = base.join(matches, (F.col("_row") == F.col("_row2")) & F.col("_key").eqNullSafe(F.col("_key2")), "left")
    text_of = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    none = F.array().cast("array<string>")
    return joined.select(
        F.col("_key").alias(key), "n_words", "n_base", "first_word", "last_word", text_of(F.col("_base")).alias("base_labels"),
        text_of(F.concat("_base", F.coalesce("_more", none))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )


def _template_rows() -> str:
    every = [(label, text.split()) for label, texts in sorted(TEMPLATES.items()) for text in texts]
    rows = [(i, label, sorted(set(words)), math.ceil(round(THRESHOLD * len(set(words)), 9)), len(words)) for i, (label, words) in enumerate(every)]
    return ", ".join(f"({i}, '{label}', {words}, {least}, {n})" for i, label, words, least, n in rows)


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS MATERIALIZED (SELECT id, doc_id, regexp_extract_all(text, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS words FROM d),
p AS (
  SELECT id, i - 1 AS place, CASE WHEN words[i] = 'mit' THEN 'mit' WHEN words[i] = 'apache' THEN 'apache' ELSE 'gpl' END AS label
  FROM (SELECT id, words, unnest(range(1, len(words) + 1)) AS i FROM w)
  WHERE (words[i] IN ('mit', 'apache') AND words[i + 1] = 'license') OR (words[i] = 'general' AND words[i + 1] = 'public' AND words[i + 2] = 'license')),
t(template, label, words, least, n) AS (VALUES {_template_rows()}),
l AS MATERIALIZED (SELECT id, list_distinct(regexp_extract_all(unnest(string_split(text, chr(10))), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS words FROM d),
tw AS (SELECT template, label, least, n, len(words) AS size, unnest(words) AS word FROM t),
e AS (SELECT id, i AS place, words[i] AS word FROM (SELECT id, words, unnest(range(1, len(words) + 1)) AS i FROM w WHERE id IN (SELECT id FROM d WHERE contains(text, chr(10))))),
h AS MATERIALIZED (SELECT id, place, template, label, least, n, size, word FROM e JOIN tw USING (word)),
r AS (
  SELECT x.id, x.label, count(DISTINCT y.word) / x.size AS containment
  FROM h AS x JOIN h AS y ON x.id = y.id AND x.template = y.template AND y.place >= x.place AND y.place < x.place + x.n
  GROUP BY x.id, x.template, x.place, x.label, x.size, x.least HAVING count(DISTINCT y.word) >= x.least),
m AS (
  SELECT id, label, len(list_intersect(l.words, t.words)) / len(t.words) AS containment FROM l, t WHERE len(list_intersect(l.words, t.words)) >= least
  UNION ALL SELECT id, label, containment FROM r),
b AS (SELECT id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY id),
a AS (SELECT id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT id, label FROM p UNION ALL SELECT id, label FROM m) GROUP BY id),
s AS (SELECT id, max(containment) AS best FROM m GROUP BY id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1e0 ELSE coalesce(best, 0e0) END AS score
FROM w LEFT JOIN b USING (id) LEFT JOIN a USING (id) LEFT JOIN s USING (id)
"""
