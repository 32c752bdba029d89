"""One query per operator over its whole table, next to the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.llm import bpe, chat, decontaminate, divergence, jaccard, language, licenses, mixing, negatives, quality, suffix, tokens, topk
from shoplens.llm.common import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_jaccard_join", jaccard.SQL)
def _(spark, folder):
    return jaccard.join(table(spark, folder, "documents"))


@query("op2_benchmark_leaks")
def _(spark, folder):
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op3_suffix_dedup")
def _(spark, folder):
    return suffix.remove_repeats(table(spark, folder, "documents"), kept="text")


@query("op4_reply_trees", chat.SQL)
def _(spark, folder):
    planted = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(planted, "conv_id long, turn long, role string, text string"))
    return chat.digests(chat.format_trees(chat.chain(turns)))


@query("op5_token_counts")
def _(spark, folder):
    import public_tokenizers

    return tokens.token_counts(table(spark, folder, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


@query("op6_quality_scores")
def _(spark, folder):
    return quality.scored(table(spark, folder, "documents"), table(spark, folder, "labels"), Tables("quality"))


@query("op7_exact_top_k", topk.SQL)
def _(spark, folder):
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), topk.whole_numbers("embedding").alias("numbers"))
    return topk.top_k(rows, rows.where("id % 50 = 0"), Tables("topk"))


@query("op8_language_id")
def _(spark, folder):
    docs = table(spark, folder, "documents")
    found = language.identify(docs, language.fit(docs))
    return found.select("doc_id", F.coalesce(quality.remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


@query("op9_license_scan", licenses.SQL)
def _(spark, folder):
    return licenses.scan(table(spark, folder, "documents"))


@query("op10_source_mix", mixing.SQL)
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", mixing.word_count("text").alias("words"))
    return mixing.mix(docs, size="words").select("doc_id", "size", "source_size", "target", "taken")


@query("op11_byte_bpe")
def _(spark, folder):
    import public_tokenizers

    return bpe.digests(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op12_hard_negatives", negatives.SQL)
def _(spark, folder):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), topk.whole_numbers("embedding").alias("numbers"))
    return negatives.mine(rows, rows.where("id % 50 = 0"), Tables("negatives"))


@query("op13_source_divergence", divergence.SQL)
def _(spark, folder):
    return divergence.audit(table(spark, folder, "documents").select("lang", "source", "text"), Tables("divergence"))
