"""Writers: parquet, CSV, run metadata and the similarity artefact."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.session import shared_folder


def run_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def keep(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """The rows, read from a table of their own below the shared folder, and its path for remove()."""
    folder = run_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more. A session without a JVM of its own leaves it to the store's retention."""
    if hasattr(spark, "_jvm"):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def nested_to_json(df: DataFrame) -> DataFrame:
    """CSV holds flat values only: arrays, maps and structs become JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema]
    )


def write_table(
    df: DataFrame, folder: str, name: str, fmt: str = "parquet", suffix: str = "", partition_by: str | None = None
) -> None:
    """<folder>/<name>/<name><suffix>.parquet and/or .csv; large tables pass a date column to partition by."""
    if fmt not in ("parquet", "csv", "both"):
        raise ValueError(f"unknown format {fmt!r}")
    base = f"{folder}/{name}/{name}{suffix}"
    if fmt in ("parquet", "both"):
        writer = df.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{base}.parquet")
    if fmt in ("csv", "both"):
        nested_to_json(df).write.mode("overwrite").option("header", True).csv(f"{base}.csv")


def write_daily(df: DataFrame, ts: str, folder: str) -> None:
    """Append rows below one folder per day of their time stamp."""
    df.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(folder)


def drop_expired_days(spark: SparkSession, folder: str, as_of: Column, days: int) -> list[str]:
    """Remove the folders of days that lie wholly before ``as_of`` less ``days``; the days removed. Only folder names are read."""
    oldest = F.to_date(as_of - F.expr(f"INTERVAL {int(days)} DAYS"))
    stored = spark.read.parquet(folder).select("day").distinct()
    expired = [str(r.day) for r in stored.where(F.col("day") < oldest).orderBy("day").collect()]
    for day in expired:
        remove(spark, f"{folder}/day={day}")
    return expired


def write_stage(tables: dict[str, DataFrame], folder: str, stage: str) -> None:
    """Cleaned tables or features of one run; the category table has no stage output."""
    for name, df in tables.items():
        if name != "categories":
            write_table(df, folder, name, suffix=f"_{stage}")


def write_metadata(spark: SparkSession, folder: str, counts: DataFrame, settings: dict[str, str]) -> DataFrame:
    """One JSON row per run with the row count of every table and the run's settings."""
    row = counts.groupBy().agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("table_name", "rows")))).alias("row_counts")
    ).withColumn("settings", F.create_map(*[F.lit(x) for kv in sorted(settings.items()) for x in kv]))
    row.write.mode("overwrite").json(f"{folder}/metadata.json")
    return spark.read.schema("row_counts map<string,bigint>, settings map<string,string>").json(f"{folder}/metadata.json")


def save_similarity(scores: DataFrame, folder: str, partitions: int | None = None) -> None:
    """Long (item_id, other_id, score) rows, range-partitioned by item so that one item's rows sit together."""
    by_item = ["item_id", F.col("score").desc(), "other_id"]
    spread = scores.repartitionByRange(partitions, *by_item) if partitions else scores.repartitionByRange(*by_item)
    spread.sortWithinPartitions(*by_item).write.mode("overwrite").parquet(folder)


def load_similarity(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("item_id bigint, other_id bigint, score double").parquet(folder)
