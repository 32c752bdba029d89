"""Cleaning of users, products and interactions."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.functions.ordered import exact_median
from shoplens.functions.scalars import full_days, weekday_flags

# fixed values
USER_DEFAULTS = {"gender": "unknown", "location": "Unknown", "income_level": "medium"}
PRODUCT_DEFAULTS = {"review_count": 0, "stock_quantity": 0}
INTERACTION_DEFAULTS = {
    "rating": 0.0, "review_text": "", "quantity": 1, "total_amount": 0.0, "payment_method": "unknown",
}
ACTIVE_DAYS = 30


def fill_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls replaced by the exact column median."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), exact_median(df, c)) for c in columns})


def fill_constants(df: DataFrame, defaults: Mapping) -> DataFrame:
    return df.fillna({c: v for c, v in defaults.items() if c in df.columns})


def trim_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    texts = [f.name for f in df.schema if f.name in columns and isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.trim(c) for c in texts})


def title_case(column: Column) -> Column:
    """Upper case after every non-letter, as in 'New-York'; initcap alone only looks at blanks."""
    marked = F.regexp_replace(F.lower(column), r"([^\p{L}]+)", "$1\u0001 ")
    return F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))


def to_number(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Unparsable text becomes null instead of failing the job under ANSI mode."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in columns if c in df.columns})


def to_time(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    temporal = (T.TimestampType, T.TimestampNTZType, T.DateType)
    parsed = {
        c: F.try_to_timestamp(F.col(c)) for c in columns if c in df.columns and not isinstance(df.schema[c].dataType, temporal)
    }
    return df.withColumns(parsed) if parsed else df


def keep_valid(df: DataFrame, valid: Column, observation: Observation | None = None) -> DataFrame:
    """Rows that are valid; with an observation the rows before and after are counted while the result is computed."""
    if observation is not None:
        df = df.observe(observation, F.count(F.lit(1)).alias("original_rows"), F.count_if(valid).alias("cleaned_rows"))
    return df.where(valid)


def clean_users(df: DataFrame, as_of: Column, observation: Observation | None = None) -> DataFrame:
    out = fill_constants(fill_median(df, ["age"]), USER_DEFAULTS)
    out = trim_columns(out.withColumn("location", title_case(F.trim("location"))), ["preference_category"])
    out = to_time(out.withColumn("email", F.lower(F.trim("email"))), ["created_at", "last_active"])
    return add_ages(keep_valid(out, F.lit(True), observation), as_of)


def add_ages(df: DataFrame, as_of: Column) -> DataFrame:
    return df.withColumns(
        {
            "days_since_created": full_days(as_of, F.col("created_at")),
            "days_since_active": full_days(as_of, F.col("last_active")),
        }
    ).withColumn("is_active", F.col("days_since_active") <= ACTIVE_DAYS)


def product_domain(price: str = "price", rating: str = "rating") -> Column:
    return (F.col(price) > 0) & F.col(rating).between(0, 5)


def add_discounts(df: DataFrame) -> DataFrame:
    percent = F.col("discount_percentage")
    return df.withColumns(
        {
            "has_discount": percent > 0,
            "final_price": F.col("price") * (F.lit(1.0) - percent / F.lit(100.0)),
            "discount_impact": percent / F.lit(100.0),
        }
    )


def clean_products(df: DataFrame, as_of: Column | None = None, observation: Observation | None = None) -> DataFrame:
    """Numbers are coerced first, so that the median of a text price is the median of its usable values."""
    out = to_number(df, ["price", "rating", "review_count", "stock_quantity"])
    out = fill_constants(fill_median(out, ["price", "rating"]), PRODUCT_DEFAULTS)
    out = keep_valid(trim_columns(out, ["name", "description", "category", "subcategory", "brand"]), product_domain(), observation)
    if "created_at" in out.columns and as_of is not None:
        out = to_time(out, ["created_at"])
        out = out.withColumn("days_since_created", full_days(as_of, F.col("created_at")))
    return add_discounts(out)


def clean_interactions(df: DataFrame, ts: str = "ts", rating_policy: str = "zero_fill", observation: Observation | None = None) -> DataFrame:
    """rating_policy: 'zero_fill' makes missing ratings 0, 'explicit' keeps them null, 'implicit' uses 1."""
    missing = {"zero_fill": 0.0, "explicit": None, "implicit": 1.0}[rating_policy]
    defaults = {c: v for c, v in INTERACTION_DEFAULTS.items() if c != "rating"}
    if missing is not None:
        defaults["rating"] = missing
    out = to_number(df, ["rating", "quantity", "total_amount", "dwell_time", "scroll_depth"])
    out = fill_constants(trim_columns(out, ["interaction_type", "session_id"]), defaults)
    in_range = F.col("rating").between(0, 5)
    if missing is None:
        in_range = F.col("rating").isNull() | in_range
    out = to_time(keep_valid(out, in_range & (F.col("quantity") > 0), observation), [ts])
    flags = weekday_flags(F.col(ts))
    return out.withColumns({c: flags[c] for c in ("hour_of_day", "day_of_week", "is_weekend")})


def cleaning_report(spark: SparkSession, tables: Mapping[str, Callable[[Observation], DataFrame]], write: Callable[[str, DataFrame], None]) -> DataFrame:
    """Clean and write every table; per table the rows before and after, counted during the write, and its seconds."""
    rows = []
    for name, clean in tables.items():
        counts, start = Observation(f"cleaning_{name}"), time.monotonic()
        write(name, clean(counts))
        rows.append((name, counts.get["original_rows"], counts.get["cleaned_rows"], time.monotonic() - start))
    return spark.createDataFrame(rows, "table_name string, original_rows bigint, cleaned_rows bigint, seconds double")


def project_available(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order, missing values as 0."""
    return df.select(*[c for c in wanted if c in df.columns]).fillna(0)


def as_document(df: DataFrame, key: str) -> DataFrame:
    """Record form for storage: key and the other columns as JSON, timestamps in ISO form."""
    rest = [c for c in df.columns if c != key]
    return df.select(key, F.to_json(F.struct(*rest), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"}).alias("document"))


def rows_of(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def rows_of_many(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")
