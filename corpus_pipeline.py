"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows and keys, empty tables and further columns of any
name, and returns the columns it was given: a null or empty text is scored like any other, is linked with nothing, has no passage and
no item, and weighs nothing in the mix.

A stage may delete the intermediate tables of the stage before it, whose result must be written by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.llm import decontaminate, jaccard, mixing, quality, suffix
from shoplens.llm.common import Tables

_LAST: list[Tables] = []
# Fixed value: bytes of a repeated passage. 51 words of the documents have 316 bytes in the median and 232 or more in 99 of 100 cases.
PASSAGE = 200


def _tables(purpose: str) -> Tables:
    while _LAST:
        _LAST.pop().drop()
    _LAST.append(Tables(purpose))
    return _LAST[-1]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, labels, _tables("pipeline-quality"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by n-gram Jaccard similarity the one with the smallest doc_id."""
    return jaccard.keep_one(docs, _tables("pipeline-jaccard"))


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand elsewhere too; n_chars follows the text.

    Passages are byte strings of PASSAGE = 200 bytes, half of what op3 asks for, so that more than 50 words reach it unless
    they average less than three letters."""
    cut = suffix.without_repeats(docs, _tables("pipeline-repeats"), length=PASSAGE)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def no_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. Columns named like those of the mix keep their values."""
    aside = {c: f"_aside_{c}" for c in docs.columns if c in mixing.MADE}
    taken = mixing.repeat_rows(mixing.mix(docs.withColumnsRenamed(aside)))
    return taken.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_near_copies),
    ("suffix-array dedup", no_repeated_passages),
    ("benchmark decontamination", no_benchmark_items),
    ("mixing sources to target weights", mixed),
]
# The classifier and the byte-wise stages have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = Tables("pipeline")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written.keep(f"stage-{number}", docs)
            written.drop(f"stage-{number - 1}")
    return docs
