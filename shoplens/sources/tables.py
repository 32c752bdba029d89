"""Readers for parquet and CSV tables, and the canonical views over the supplied tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from shoplens import schemas
from shoplens.functions.scalars import lookup
from shoplens.session import free_shuffles

# fixed values of the canonical mapping
SEGMENT_CATEGORY = {
    "BUILDING": "ECONOMY", "AUTOMOBILE": "STANDARD", "MACHINERY": "LARGE", "HOUSEHOLD": "MEDIUM", "FURNITURE": "SMALL",
}
FLAG_TYPE = {"N": "purchase", "A": "add_to_cart", "R": "view"}
SHOP_NOW = "2001-12-01 00:00:00"
STREAM_NOW = "2024-01-31 00:00:00"
USER_EVERY = 5


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet scan with a declared schema; a missing path is an error."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV scan with header. Array columns are stored as JSON text and decoded here."""
    flat = T.StructType(
        [T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.ArrayType) else f.dataType) for f in schema]
    )
    df = spark.read.option("header", True).schema(flat).csv(path)
    return df.select(
        *[
            F.from_json(f.name, f.dataType).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)
            for f in schema
        ]
    )


def read_table(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """<folder>/<name>/<name>.parquet, else the .csv beside it, else an error."""
    base = f"{folder}/{name}/{name}"
    try:
        return read_parquet(spark, f"{base}.parquet", schema)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    try:
        return read_csv(spark, f"{base}.csv", schema)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        raise FileNotFoundError(f"no parquet or CSV data for table {name!r} under {folder}") from None


def load_tables(spark: SparkSession, folder: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {name: read_table(spark, folder, name, schemas.TABLES[name]) for name in names}


def within_age(df: DataFrame, ts: str, as_of: Column, days: int, day: str | None = None) -> DataFrame:
    """Retention: rows not older than ``days`` at ``as_of``. With a ``day`` column, by which the table is partitioned, older
    partitions are not read."""
    oldest = as_of - F.expr(f"INTERVAL {int(days)} DAYS")
    kept = df.where(F.col(ts) >= oldest)
    return kept.where(F.col(day) >= F.to_date(oldest)) if day else kept


def as_clickstream(events: DataFrame) -> DataFrame:
    """Shop events, batch or stream; the source's 'signup' rows play the add-to-cart stage, every tenth dwell time is unknown."""
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        "event_id",
        "user_id",
        k.alias("product_id"),
        F.when(F.col("event_type") == "signup", "add_to_cart").otherwise(F.col("event_type")).alias("event_type"),
        "ts",
        F.when(F.col("event_id") % 10 != 3, F.col("value")).alias("dwell_time"),
        k.cast("double").alias("scroll_depth"),
        F.element_at(F.array(*map(F.lit, schemas.DEVICES)), (F.col("event_id") % 3 + 1).cast("int")).alias("device_type"),
        F.concat(F.lit("NATION_"), (F.col("user_id") % 25).cast("string")).alias("location"),
    )


class Shop:
    """The supplied tables of one folder, and the shop's relations derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        free_shuffles(spark)

    def table(self, name: str) -> DataFrame:
        return read_parquet(self.spark, f"{self.folder}/{name}.parquet", schemas.SUPPLIED.get(name))

    @property
    def now(self) -> Column:
        return F.lit(SHOP_NOW).cast("timestamp")

    @property
    def stream_now(self) -> Column:
        return F.lit(STREAM_NOW).cast("timestamp")

    @cached_property
    def users(self) -> DataFrame:
        span = self.table("orders").groupBy(F.col("o_custkey").alias("user_id")).agg(
            F.min("o_orderdate").alias("created_at"), F.max("o_orderdate").alias("last_active")
        )
        key, balance = F.col("c_custkey"), F.col("c_acctbal")
        people = self.table("customer").join(
            self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left"
        ).select(
            key.alias("user_id"),
            (F.lit(13) + key % 80).cast("int").alias("age"),
            F.element_at(F.array(*map(F.lit, schemas.GENDERS)), (key % 3 + 1).cast("int")).alias("gender"),
            F.col("n_name").alias("location"),
            F.when(balance < 0, "low").when(balance < 3000, "medium").when(balance < 7000, "high").otherwise("luxury")
            .alias("income_level"),
            lookup(F.col("c_mktsegment"), SEGMENT_CATEGORY).alias("preference_category"),
            F.element_at(F.array(*map(F.lit, schemas.DEVICES)), (key % 3 + 1).cast("int")).alias("device_type"),
            F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@shop.example")).alias("email"),
        )
        return people.join(span, "user_id", "left")

    @cached_property
    def products(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.table("part").select(
            key.alias("product_id"),
            F.col("p_name").alias("name"),
            F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("description"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("brand"),
            F.col("p_size").alias("size"),
            F.col("p_retailprice").alias("price"),
            (key % 40).cast("double").alias("discount_percentage"),
            (key % 97).cast("int").alias("stock_quantity"),
            (F.lit(1.0) + (key % 41) / F.lit(10.0)).alias("rating"),
            (key % 500).cast("int").alias("review_count"),
        )

    @cached_property
    def interactions(self) -> DataFrame:
        lines, orders = self.table("lineitem"), self.table("orders")
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("o_custkey").alias("user_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_orderkey").alias("session_id"),
            F.col("l_linenumber").alias("line"),
            lookup(F.col("l_returnflag"), FLAG_TYPE).alias("interaction_type"),
            F.col("l_shipdate").alias("ts"),
            F.when(F.col("l_returnflag") != "R", (F.lit(1) + F.col("l_linenumber") % 5).cast("double")).alias("rating"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.col("l_extendedprice").alias("total_amount"),
            F.when(F.col("l_returnflag") != "A", (F.col("l_suppkey") % 300).cast("int")).alias("dwell_time"),
            ((F.col("l_partkey") + F.col("l_suppkey")) % 101).cast("int").alias("scroll_depth"),
        )

    @cached_property
    def clickstream(self) -> DataFrame:
        return as_clickstream(self.table("events"))

    @cached_property
    def metrics(self) -> DataFrame:
        """Service metric samples: latency per served request, one error sample per failed one."""
        failed = F.col("event_type") == "error"
        return self.table("events").select(
            "event_id",
            "ts",
            F.when(failed, "error").otherwise("latency_ms").alias("metric_name"),
            F.when(failed, F.lit(1.0)).otherwise(F.col("value")).alias("metric_value"),
            "user_id",
            F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("model_version"),
        )

    @cached_property
    def user_factors(self) -> DataFrame:
        return self.table("embeddings").where(F.col("vec_id") % USER_EVERY == 0).select(
            F.expr(f"vec_id div {USER_EVERY}").alias("id"), F.col("embedding").alias("vector")
        )

    @cached_property
    def item_factors(self) -> DataFrame:
        return self.table("embeddings").where(F.col("vec_id") % USER_EVERY != 0).select(
            F.expr(f"vec_id - vec_id div {USER_EVERY} - 1").alias("id"), F.col("embedding").alias("vector")
        )

    @cached_property
    def raw_users(self) -> DataFrame:
        """Users as a careless source would deliver them: gaps, padding, mixed case, timestamps as text."""
        key = F.col("user_id")
        return self.users.select(
            "user_id",
            F.when(key % 7 != 0, F.col("age")).alias("age"),
            F.when(key % 5 != 0, F.col("gender")).alias("gender"),
            F.when(key % 9 != 0, F.concat(F.lit("  "), F.replace(F.lower("location"), F.lit("_"), F.lit(" ")), F.lit(" ")))
            .alias("location"),
            F.when(key % 4 != 0, F.col("income_level")).alias("income_level"),
            F.concat(F.lit(" "), F.col("preference_category")).alias("preference_category"),
            "device_type",
            F.concat(F.lit(" "), F.upper("email"), F.lit("  ")).alias("email"),
            F.when(key % 8 == 0, "not a date").otherwise(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).alias("created_at"),
            F.date_format("last_active", "yyyy-MM-dd HH:mm:ss").alias("last_active"),
        )

    @cached_property
    def raw_products(self) -> DataFrame:
        """Products with prices as text, some unusable, and ratings partly missing or out of range."""
        key = F.col("product_id")
        return self.products.select(
            "product_id",
            F.concat(F.lit("  "), F.col("name"), F.lit(" ")).alias("name"),
            F.col("category"),
            F.col("brand"),
            F.when(key % 17 == 0, F.lit(None).cast("string"))
            .when(key % 13 == 0, F.concat(F.col("price").cast("string"), F.lit("x")))
            .when(key % 19 == 0, "-1")
            .otherwise(F.col("price").cast("string")).alias("price"),
            "discount_percentage",
            F.when(key % 6 != 0, (key % 56) / F.lit(10.0)).alias("rating"),
            F.when(key % 10 != 0, F.col("review_count")).alias("review_count"),
            F.when(key % 14 != 0, F.col("stock_quantity")).alias("stock_quantity"),
        )

    @cached_property
    def raw_interactions(self) -> DataFrame:
        """Interactions as logged: some users and products are not in their tables, and a fifth of the products is never rated."""
        user, product, session = F.col("user_id"), F.col("product_id"), F.col("session_id")
        return self.interactions.withColumns(
            {
                "user_id": F.when(session % 13 == 0, -user).otherwise(user),
                "product_id": F.when((session + F.col("line")) % 11 == 0, product + 1_000_000_000).otherwise(product),
                "rating": F.when(product % 5 != 0, F.col("rating")),
            }
        )
