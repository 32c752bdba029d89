"""Event topics: Kafka on a cluster, JSON or parquet files with the same record form elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.schemas import CLICKSTREAM

CORRUPT = "_corrupt_record"
RECORD = "key string, value string"


def kafka_records(spark: SparkSession, servers: str, topic: str, max_per_trigger: int | None = None) -> DataFrame:
    """(key, value) text from a topic, from its beginning; needs the connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option(
        "startingOffsets", "earliest"
    )
    if max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return reader.load().select(F.col("key").cast("string"), F.col("value").cast("string"))


def file_records(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """(key, value) text from a folder of JSON record files."""
    reader = spark.readStream.schema(RECORD)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).json(folder)


def parquet_events(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def decode(records: DataFrame, schema: T.StructType = CLICKSTREAM) -> DataFrame:
    """Fields of the JSON value; a value that does not parse keeps its text in the corrupt column and stops nothing."""
    wanted = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]"}
    return records.select("key", F.from_json("value", wanted, options).alias("e")).select("key", "e.*")


def encode(events: DataFrame, key: str) -> DataFrame:
    """Keyed JSON records."""
    text = F.to_json(F.struct("*"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    return events.select(F.col(key).cast("string").alias("key"), text.alias("value"))
