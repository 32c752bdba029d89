"""Keyed tables that a stream keeps up to date from foreachBatch: merged on read, or rewritten bucket by bucket.

Both are written so that a repeated batch replaces what it wrote before, and both publish a state by a pointer that is
written last. A reader follows the newest pointer.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.functions.scalars import type_count
from shoplens.schemas import FUNNEL
from shoplens.sources.sinks import remove

SKETCH_LOG2 = 12
# Three standard errors of a sketch with 2**12 registers.
SKETCH_BOUND = 3 * 1.04 / 2 ** (SKETCH_LOG2 / 2)
BUCKETS, COMPACT_EVERY = 64, 8
Partial = Callable[[DataFrame], DataFrame]


class Pointers:
    """Small tables, one per batch, that say which files a state consists of."""

    def __init__(self, folder: str, schema: str):
        self.folder, self.schema = f"{folder}/pointer", schema

    def write(self, spark: SparkSession, batch: int, rows: Sequence[tuple]) -> None:
        spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")

    def newest(self, spark: SparkSession, before: int | None = None) -> list[tuple]:
        """Rows of the newest pointer, or of the newest one before a batch; none if there is none."""
        try:
            kept = spark.read.schema(f"{self.schema}, batch bigint").parquet(self.folder)
        except Exception as error:  # noqa: BLE001 - only a folder that is not there yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return []
        kept = kept if before is None else kept.where(F.col("batch") < before)
        last = kept.agg(F.max("batch").alias("b")).first().b
        return [] if last is None else [tuple(r) for r in kept.where(F.col("batch") == last).drop("batch").collect()]


class MergedTable:
    """Totals per key as partial aggregates, one delta per batch.

    ``partial`` turns the events of a batch into partial aggregates, and ``merge`` is associative: it turns partial aggregates of
    several batches into one per key. Every ``compact_every`` batches the deltas so far become a new base. The base and the deltas
    that a repeat of the last batch would need stay; older ones are removed.
    """

    def __init__(self, folder: str, partial: Partial, merge: Partial, compact_every: int = COMPACT_EVERY):
        self.folder, self.partial, self.merge, self.compact_every = folder, partial, merge, compact_every
        self.pointers = Pointers(folder, "upto bigint")

    def __call__(self, df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        self.partial(df).write.mode("overwrite").parquet(f"{self.folder}/deltas/batch={batch}")
        if (batch + 1) % self.compact_every == 0:
            bases = self.pointers.newest(spark, before=batch)
            upto = bases[0][0] if bases else -1
            self._state(spark, upto, batch).write.mode("overwrite").parquet(f"{self.folder}/base/upto={batch}")
            self.pointers.write(spark, batch, [(batch,)])
            for old in range(max(0, upto - self.compact_every + 1), upto + 1):
                remove(spark, f"{self.folder}/deltas/batch={old}")
            remove(spark, f"{self.folder}/base/upto={upto - self.compact_every}")

    def _state(self, spark: SparkSession, upto: int, last: int | None = None) -> DataFrame:
        deltas = spark.read.parquet(f"{self.folder}/deltas").where(F.col("batch") > upto)
        deltas = (deltas if last is None else deltas.where(F.col("batch") <= last)).drop("batch")
        return self.merge(deltas if upto < 0 else deltas.unionByName(spark.read.parquet(f"{self.folder}/base/upto={upto}")))

    def read(self, spark: SparkSession) -> DataFrame:
        """One merged partial aggregate per key."""
        bases = self.pointers.newest(spark)
        return self._state(spark, bases[0][0] if bases else -1)


def added_maps(maps: Column) -> Column:
    """One map with the sums of an array of count maps; an array of none gives an empty map."""
    add = lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return F.aggregate(maps, F.create_map().cast("map<string,bigint>"), lambda total, one: F.map_zip_with(total, one, add))


def partial_totals(events: DataFrame, keys: Sequence[str] = (), audience: Sequence[str] = (), spread: dict[str, Column] | None = None) -> DataFrame:
    """Counts, exact sums, last activity, a sketch of the distinct values of every ``audience`` column, and one map of counts
    with 'distribution:value' as key."""
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,9)"))
    measures = [
        F.count(F.lit(1)).alias("total_events"), *[type_count("event_type", t).alias(f"{t}_count") for t in FUNNEL],
        exact("dwell_time").alias("total_dwell_time"), exact("scroll_depth").alias("total_scroll_depth"), F.max("ts").alias("last_activity"),
        *[F.hll_sketch_agg(c, SKETCH_LOG2).alias(f"{c}_sketch") for c in audience],
    ]
    found = events.groupBy(*keys).agg(*measures)
    if not spread:
        return found
    entry = F.explode(F.array(*[F.concat(F.lit(f"{name}:"), value) for name, value in spread.items()])).alias("entry")
    counted = events.select(*keys, entry).where("entry is not null").groupBy(*keys, "entry").agg(F.count(F.lit(1)).alias("n"))
    counts = counted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("entry", "n"))).alias("counts"))
    return merge_totals(keys)(found.unionByName(counts, allowMissingColumns=True))


def merge_totals(keys: Sequence[str] = ()) -> Partial:
    """Associative merge of ``partial_totals``: sums, maxima, sketch unions and added maps. Missing parts count as nothing."""

    def merge(partials: DataFrame) -> DataFrame:
        measures = []
        for field in partials.schema:
            name, column = field.name, F.col(field.name)
            if name in keys:
                continue
            if name.endswith("_sketch"):
                measures.append(F.hll_union_agg(column).alias(name))
            elif isinstance(field.dataType, T.MapType):
                measures.append(added_maps(F.collect_list(column)).alias(name))
            elif isinstance(field.dataType, T.TimestampType):
                measures.append(F.max(column).alias(name))
            else:
                measures.append(F.sum(column).cast(field.dataType).alias(name))
        return partials.groupBy(*keys).agg(*measures)

    return merge


def finished_totals(merged: DataFrame, spread: Sequence[str] = ()) -> DataFrame:
    """Sums as doubles, sketches as estimates (``unique_<column>``), and every distribution as 'value:count' text by value."""
    for name in [c for c in merged.columns if c.endswith("_sketch")]:
        merged = merged.withColumn(f"unique_{name.removesuffix('_sketch')}", F.hll_sketch_estimate(name)).drop(name)
    for name in spread:
        own = F.filter(F.map_entries("counts"), lambda e: F.startswith(e["key"], F.lit(f"{name}:")))  # noqa: B023
        texts = F.transform(F.array_sort(own), lambda e: F.concat(F.substr(e["key"], F.lit(len(f"{name}:") + 1)), F.lit(":"), e["value"].cast("string")))  # noqa: B023
        merged = merged.withColumn(f"{name}_distribution", F.array_join(texts, ","))
    return merged.drop("counts").withColumns({c: F.col(c).cast("double") for c in ("total_dwell_time", "total_scroll_depth")})


class BucketTable:
    """One row per key in hash buckets; a batch rewrites only the buckets that its keys fall into.

    Version n of a bucket lies in data/version=n/_bucket=b and is its last version merged with batch n. The pointer names the
    current and the previous version of every bucket, and both stay readable; older files are removed.
    """

    def __init__(self, folder: str, key: str, schema: T.StructType, derive: Partial, merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS):
        self.folder, self.key, self.schema, self.derive, self.merge, self.buckets = folder, key, schema, derive, merge, buckets
        self.pointers = Pointers(folder, "bucket bigint, version bigint, previous bigint")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets))

    def _rows(self, spark: SparkSession, versions: dict[int, int]) -> DataFrame:
        if not versions:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*[f"{self.folder}/data/version={v}/_bucket={b}" for b, v in sorted(versions.items())])

    def __call__(self, df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        changes = self.derive(df).persist()
        try:
            touched = [r.b for r in changes.select(self._bucket().alias("b")).distinct().collect()]  # at most ``buckets``
            if not touched:
                return
            before = {b: (v, p) for b, v, p in self.pointers.newest(spark, before=batch)}
            stored = self._rows(spark, {b: before[b][0] for b in touched if b in before})
            rows = self.merge(stored, changes).select(*self.schema.names).withColumn("_bucket", self._bucket())
            rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/data/version={batch}")
            written = {r["_bucket"] for r in spark.read.parquet(f"{self.folder}/data/version={batch}").select("_bucket").distinct().collect()}
        finally:
            changes.unpersist()
        after = {b: (batch, before[b][0] if b in before else None) if b in written else versions for b, versions in {**before, **dict.fromkeys(written)}.items()}
        self.pointers.write(spark, batch, [(b, v, p) for b, (v, p) in sorted(after.items())])
        for b in written:
            if b in before and before[b][1] is not None:
                remove(spark, f"{self.folder}/data/version={before[b][1]}/_bucket={b}")

    def read(self, spark: SparkSession, previous: bool = False) -> DataFrame:
        """The newest published state, or with every bucket at its previous version, where it has one."""
        pointers = self.pointers.newest(spark)
        return self._rows(spark, {b: p if previous and p is not None else v for b, v, p in pointers})
