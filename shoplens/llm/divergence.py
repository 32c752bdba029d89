"""Source divergence audit: how far the sources of a language use its terms unlike each other and unlike the language.

A task folds whole documents into hash stripes, term -> (document frequency, counts by source), and spills them when they hold
SPILL entries. Stripes of one term meet by key in one shuffle and are merged there; a term has at most as many rows as there
were spills, whatever its frequency. Merged stripes, dealt over buckets with the totals of their language beside them, emit
the divergences: sums for every two sources and the best terms of every source, which are added up and ranked at the end.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoplens.llm.common import Tables

SPILL = 1 << 19
BUCKET_TERMS = 4096
CELLS = 1 << 20
# Documents that a kept term stands in, terms listed per group, and the smoothing of the shares.
MIN_DOCS, TOP_TERMS, SMOOTHING, SCALE_STEPS = 30, 50, 5, 3
TERM = re.compile(rb"[a-z\x80-\xff]+")  # after A-Z have become a-z


def stripes(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", spill: int = SPILL) -> DataFrame:
    """lang, term, df, sources and counts: one row per term and spill of a task. Null lang, source and text are empty."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[bytes, list]] = {}
        entries = 0

        def spilled() -> Iterator[pa.RecordBatch]:
            for name, terms in held.items():
                counts = [stripe[1] for stripe in terms.values()]
                borders = pa.array(np.cumsum([0, *map(len, counts)]), pa.int32())
                columns = [
                    pa.array([name] * len(terms), pa.string()), pa.array(list(terms), pa.binary()).cast(pa.string()), pa.array([stripe[0] for stripe in terms.values()], pa.int64()),
                    pa.ListArray.from_arrays(borders, pa.array([s for c in counts for s in c], pa.string())),
                    pa.ListArray.from_arrays(borders, pa.array([n for c in counts for n in c.values()], pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "term", "df", "sources", "counts"])

        for batch in batches:
            for name, origin, value in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"]):
                terms = held.setdefault(name, {})
                for term, count in Counter(TERM.findall(value.as_buffer().to_pybytes().lower())).items():
                    stripe = terms.get(term)
                    if stripe is None:
                        terms[term] = [1, {origin: count}]
                        entries += 2
                    else:
                        stripe[0] += 1
                        by_source = stripe[1]
                        if origin in by_source:
                            by_source[origin] += count
                        else:
                            by_source[origin] = count
                            entries += 1
                if entries >= spill:
                    yield from spilled()
                    held, entries = {}, 0
        yield from spilled()

    filled = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    return filled.mapInArrow(fold, "lang string, term string, df bigint, sources array<string>, counts array<bigint>")


def merged(parts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term and counts (source, n) of every term in at least ``min_docs`` documents of its language, after one shuffle."""
    dealt = parts.repartition("lang", "term")
    whole = F.array(F.struct(F.lit(None).cast("string").alias("source"), F.col("df").alias("n")))  # no source: the documents
    entry = F.explode(F.concat(whole, F.transform(F.arrays_zip("sources", "counts"), lambda x: F.struct(x["sources"].alias("source"), x["counts"].alias("n")))))
    summed = dealt.select("lang", "term", entry.alias("e")).groupBy("lang", "term", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("n"))
    stripe = summed.groupBy("lang", "term").agg(
        F.max(F.when(F.col("source").isNull(), F.col("n"))).alias("df"), F.collect_list(F.when(F.col("source").isNotNull(), F.struct("source", "n"))).alias("counts")
    )
    return stripe.where(F.col("df") >= min_docs).drop("df")


def shares(counts: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(1000000000 * (count + 5) / (total + 5 * terms)), exact while total + 5 * terms stays below 9 * 10**15."""
    below = np.asarray(total, np.int64) + SMOOTHING * terms
    rest = counts.astype(np.int64) + SMOOTHING
    found = np.zeros(rest.shape, np.int64)
    for _ in range(SCALE_STEPS):  # long division, three decimal places at a time
        rest = rest * 1000
        found = found * 1000 + rest // below
        rest = rest % below
    return found + 1


def emitted(part: pd.DataFrame, totals: pd.DataFrame, top: int = TOP_TERMS) -> pd.DataFrame:
    """From merged stripes of one language: for every two sources the sum of differences, for every source its best terms."""
    schema = ["lang", "source", "part", "item", "value"]
    if not len(part) or not len(totals):
        return pd.DataFrame({name: [] for name in schema}, dtype=object)
    row = totals.iloc[0]
    sources, total, terms = list(row["sources"]), np.array(row["totals"], np.int64), int(row["terms"])
    number = {s: i for i, s in enumerate(sources)}
    part = part.sort_values("term", kind="stable")  # code points, which is the order of UTF-8
    sums = np.zeros((len(sources), len(sources)), np.int64)
    best: list[list[tuple[int, str]]] = [[] for _ in sources]
    step = max(1, CELLS // len(sources))
    for start in range(0, len(part), step):
        chunk = part.iloc[start : start + step]
        counts = np.zeros((len(chunk), len(sources)), np.int64)
        for i, entries in enumerate(chunk["counts"]):
            for entry in entries:
                counts[i, number[entry["source"]]] = entry["n"]
        own, whole = shares(counts, total[None, :], terms), shares(counts.sum(1), total.sum(), terms)
        names = chunk["term"].to_numpy()
        for s in range(len(sources)):
            sums[s, s + 1 :] += np.abs(own[:, s + 1 :] - own[:, s : s + 1]).sum(0)
            over = np.flatnonzero((counts[:, s] > 0) & (own[:, s] > whole))
            gain = own[over, s] - whole[over]
            first = np.argsort(-gain, kind="stable")[:top]
            best[s] = sorted(best[s] + [(-int(gain[i]), names[over[i]]) for i in first])[:top]
    low, high = np.triu_indices(len(sources), 1)
    rows = [(sources[a], "pair", sources[b], int(sums[a, b])) for a, b in zip(low.tolist(), high.tolist())]
    rows += [(sources[s], "term", term, -less) for s in range(len(sources)) for less, term in best[s]]
    out = pd.DataFrame(rows, columns=schema[1:])
    out.insert(0, "lang", row["lang"])
    return out


def audit(
    docs: DataFrame, tables: Tables, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, spill: int = SPILL, bucket_terms: int = BUCKET_TERMS
) -> DataFrame:
    """lang, source, part, item, value and rank of every (lang, source) that occurs.

    Part ``pair``: every other source of the language with the summed difference of shares over all kept terms, 0 where none
    is kept. Part ``term``: the 50 kept terms that the group uses most above the language. Ties go to the smaller item.
    Null lang, source and text are empty; repeated rows count each; an empty table gives none; other columns are not read.
    A text's distinct terms, the stripes before a spill, and a matrix over the sources of one language are what a task holds.
    """
    kept = tables.keep("merged", merged(stripes(docs, lang, source, text, spill), min_docs))
    filled = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"))
    groups = tables.keep("groups", filled.distinct())
    counted = kept.select("lang", F.explode("counts").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("total"))
    filled_groups = groups.join(counted, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    listed = filled_groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("g"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = listed.join(terms, "lang").select("lang", "terms", F.col("g.source").alias("sources"), F.col("g.total").alias("totals"))
    buckets = -(-kept.count() // bucket_terms) or 1
    dealt = kept.withColumn("bucket", F.pmod(F.xxhash64("lang", "term"), F.lit(buckets)))
    beside = tables.keep("beside", dealt.select("lang", "bucket").distinct().join(totals, "lang"))
    found = dealt.groupBy("lang", "bucket").cogroup(beside.groupBy("lang", "bucket")).applyInPandas(lambda part, beside: emitted(part, beside), "lang string, source string, part string, item string, value bigint")
    found = tables.keep("found", found)
    one_way = found.where("part = 'pair'").select("lang", "source", "item", "value")
    none = groups.join(groups.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("bigint"))
    pairs = none.unionByName(one_way).unionByName(one_way.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = found.where("part = 'term'").select("lang", "source", "item", "value").withColumn("rank", rank).where(F.col("rank") <= TOP_TERMS)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", rank).withColumn("part", F.lit("pair")).select(columns).unionByName(best.withColumn("part", F.lit("term")).select(columns))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS words FROM documents),
w AS MATERIALIZED (SELECT id, lang, source, unnest(words) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS MATERIALIZED (
  SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 5)) // CAST(n + 5 * v AS HUGEINT) AS p
  FROM n JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (
  SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (s + 5)) // CAST(n + 5 * v AS HUGEINT) AS q
  FROM (SELECT lang, term, sum(c) AS s FROM c GROUP BY lang, term) JOIN (SELECT lang, sum(c) AS n FROM c GROUP BY lang) USING (lang) JOIN v USING (lang)),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN p AS x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p AS y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 50
"""
