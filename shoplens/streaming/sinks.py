"""Stream outputs. Every query keeps its own checkpoint, and file outputs are written per batch number, so a batch
that is repeated after a failure replaces itself."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from shoplens.streaming.keyed import BucketTable, MergedTable

Handler = Callable[[DataFrame, int], None]


def to_kafka(records: DataFrame, servers: str, topic: str, checkpoint: str):
    """Writer for keyed records, acknowledged by all replicas."""
    return (
        records.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all")
        .option("topic", topic).option("checkpointLocation", checkpoint)
    )


def write_batch(df: DataFrame, folder: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def run_available(stream: DataFrame, handler: Handler, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there now in bounded batches, then stop: the bounded form of consuming a topic."""
    query = (
        stream.writeStream.foreachBatch(handler).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def append_table(stream: DataFrame, folder: str) -> StreamingQuery:
    """Append-only output as one table."""
    return run_available(stream, lambda df, batch: write_batch(df, f"{folder}/data", batch), f"{folder}/checkpoint")


def update_table(stream: DataFrame, folder: str) -> StreamingQuery:
    """Changed rows of an aggregate, batch by batch."""
    return run_available(stream, lambda df, batch: write_batch(df, f"{folder}/data", batch), f"{folder}/checkpoint", "update")


def appended(spark, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/data").drop("batch")


def latest_updates(spark, folder: str, keys: list[str]) -> DataFrame:
    """The last written row per key of an update table."""
    rows = spark.read.parquet(f"{folder}/data")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    if not keys:
        return rows.agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("r.*")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def route(outputs: Mapping[str, Callable[[DataFrame], DataFrame] | Handler], folder: str) -> Handler:
    """One input to several tables: the batch is read once and kept while in use. An output is a derivation whose rows are
    appended, or a keyed table that takes the batch itself."""

    def handle(df: DataFrame, batch: int) -> None:
        df.persist()
        try:
            for name, output in outputs.items():
                if isinstance(output, (MergedTable, BucketTable)):
                    output(df, batch)
                else:
                    write_batch(output(df), f"{folder}/{name}", batch)
        finally:
            df.unpersist()

    return handle


class ProgressLog(StreamingQueryListener):
    """Appends the progress of every batch of a session's streams to a table; what waits in memory is at most ``keep`` rows."""

    SCHEMA = "run string, batch bigint, input_rows bigint, seconds double, late_rows bigint"

    def __init__(self, spark: SparkSession, folder: str, keep: int = 50):
        self.spark, self.folder, self.keep = spark, folder, keep
        self.waiting: list[tuple] = []
        self.ended: dict[str, threading.Event] = {}

    def _write(self) -> None:
        if self.waiting:
            rows, self.waiting = self.waiting, []
            self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)

    def onQueryStarted(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event())

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        self.waiting.append((str(p.runId), p.batchId, p.numInputRows, p.durationMs.get("triggerExecution", 0) / 1000.0, late))
        if len(self.waiting) >= self.keep:
            self._write()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._write()
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def of(self, query: StreamingQuery, seconds: float = 120.0) -> DataFrame:
        """Batches of a finished query; its last events may still be on their way."""
        if not self.ended.setdefault(str(query.runId), threading.Event()).wait(seconds):
            raise TimeoutError(f"the end of stream {query.runId} has not been reported within {seconds:.0f} s")
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder).where(F.col("run") == str(query.runId)).drop("run")


@contextmanager
def logged(spark: SparkSession, folder: str) -> Iterator[ProgressLog]:
    """A progress log that listens while the block runs."""
    log = ProgressLog(spark, folder)
    spark.streams.addListener(log)
    try:
        yield log
    finally:
        spark.streams.removeListener(log)
