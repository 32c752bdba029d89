"""Mixing sources to target weights by systematic sampling.

Within a source documents stand in order of size, every document adds the source's expected copies per document to a
prefix sum that starts at one random offset, and a document is taken once per integer that its step crosses. Positions
come from counts per size, then per salt within a size, then a row number, so that no task numbers a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SOURCE = ["_missing", "_source"]
SIZE = [*SOURCE, "size"]
SALT = [*SIZE, "_salt"]


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """One row per source: source_size and target.

    All words are shared by weight; a source stops at ``most`` times its own words and the rest is shared again. In
    the order of words per weight the sources that stop come first, so prefix sums give the final level at once.
    """
    name = [F.col("_missing"), F.col("_source")]
    everything = W.partitionBy()
    place = F.pmod(F.row_number().over(W.orderBy(*name)) - 1, F.lit(len(weights)))
    cap, weight = F.col("_cap"), F.col("_weight")
    by_ratio = W.orderBy(cap / weight, *name)
    earlier = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    rows = (
        sizes.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"))
        .withColumn("_weight", F.get(F.array(*[F.lit(int(w)).cast("long") for w in weights]), place))
        .withColumn("_cap", F.col("source_size") * most)
        .withColumn("_left", F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0)))
        .withColumn("_share", F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(earlier), F.lit(0)))
        .withColumn("_order", F.row_number().over(by_ratio))
        .withColumn("_level", F.col("_left").cast("double") / F.col("_share").cast("double"))
    )
    free = F.when(F.col("_left") * weight <= cap * F.col("_share"), F.col("_order"))
    level = F.coalesce(F.min_by("_level", free).over(everything), F.lit(0.0))
    return rows.select(*SOURCE, "source_size", F.least(cap.cast("double"), level * weight).alias("target"))


MADE = ("size", "source_size", "target", "copies", "taken")


def offset(seed: str) -> Column:
    """A fraction in steps of 1/65536 from the seed and the source; reruns agree."""
    name = F.when(F.col("_missing"), F.lit("null")).otherwise(F.concat(F.lit("source "), "_source"))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed} "), name)), 1, 4), 16, 10).cast("double") / 65536.0


def mix(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: str = "mix",
    key: str = "doc_id", text: str = "text", source: str = "source", size: str | None = None,
) -> DataFrame:
    """The input's columns, then size, source_size, target, copies (times the mix takes the row) and taken words.

    A row's size is the number of words of its text, or the column ``size`` where it is counted already. Sources count
    by code point, null last, and weigh ``weights``, repeating. Null or empty texts have size 0 and add
    nothing wherever they fall. Repeated rows and null keys are rows of their own; rows alike in source, size and key
    may swap copies. An empty table gives none. Input columns with the names above are replaced.
    """
    mine = [c for c in docs.columns if c not in MADE]
    rows = docs.select(
        F.struct(*mine).alias("_row"), F.col(key).alias("_key"), F.col(source).isNull().alias("_missing"),
        F.coalesce(source, F.lit("")).alias("_source"), (F.coalesce(F.col(size), F.lit(0)).cast("long") if size else word_count(text)).alias("size"),
        F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 3).alias("_salt"),
    )
    counts = rows.groupBy(*SALT).agg(F.count(F.lit(1)).alias("_n"))
    before = lambda by, order: F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    by_size = counts.groupBy(*SIZE).agg(F.sum("_n").alias("_n"))
    by_size = by_size.select(*SIZE, before(SOURCE, ["size"]).alias("_size_start"))
    starts = counts.select(*SALT, before(SIZE, ["_salt"]).alias("_salt_start")).join(by_size, SIZE)
    level = targets(counts.select(*SOURCE, (F.col("size") * F.col("_n")).alias("size")), weights, most)
    starts = starts.join(level, SOURCE).withColumn("_offset", offset(seed))
    numbered = rows.withColumn("_n", F.row_number().over(W.partitionBy(*SALT).orderBy("_key"))).join(starts, SALT)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    position = (F.col("_size_start") + F.col("_salt_start") + F.col("_n")).cast("double")
    crossed = F.floor(F.col("_offset") + position * rate) - F.floor(F.col("_offset") + (position - 1.0) * rate)
    return numbered.withColumn("copies", F.least(crossed, F.lit(most)).cast("long")).select(
        *[F.col("_row").getField(c).alias(c) for c in mine],
        "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
    )


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """Every row as often as its copies say, so never more than the mix's bound."""
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("copies")))).where(F.col("_copy") > 0).drop("_copy")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS missing, coalesce(source, '') AS src,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3) AS salt FROM documents),
sources AS (
  SELECT missing, src, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY missing, src) - 1) % 3 AS weight
  FROM sized GROUP BY 1, 2),
ranked AS (
  SELECT *, row_number() OVER w AS place, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER p, 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS share FROM sources
  WINDOW w AS (ORDER BY 3.0 * source_size / weight, missing, src),
    p AS (ORDER BY 3.0 * source_size / weight, missing, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT coalesce(arg_min(CAST(rest AS DOUBLE) / CAST(share AS DOUBLE), place) FILTER (rest * weight <= 3 * source_size * share), 0) AS level FROM ranked),
aims AS (
  SELECT missing, src, source_size, least(CAST(3 * source_size AS DOUBLE), level * weight) AS target,
    CAST(CAST('0x' || substr(md5('mix ' || CASE WHEN missing THEN 'null' ELSE 'source ' || src END), 1, 4) AS INTEGER) AS DOUBLE) / 65536e0 AS start
  FROM ranked, level),
placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY missing, src ORDER BY size, salt, doc_id NULLS FIRST) AS DOUBLE) AS position,
    CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 0e0 END AS rate
  FROM sized JOIN aims USING (missing, src))
SELECT doc_id, size, source_size, target,
  CAST(least(floor(start + position * rate) - floor(start + (position - 1e0) * rate), 3) AS BIGINT) * size AS taken FROM placed
"""
