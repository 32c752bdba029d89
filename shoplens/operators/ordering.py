"""Top-n, ranks, splits, samples, percentiles and comparisons of ranked lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoplens.functions.ordered import exact_quantiles, running

# fixed values: the percentiles that are reported, and the sample size they need
PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
MIN_SAMPLE = 10
HASH_DIGITS = 15


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows per key. Written on row_number so that every task keeps only n rows per key before the shuffle."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def recent(df: DataFrame, key: str, n: int = 5, ts: str = "ts", ties: Sequence[str] = ()) -> DataFrame:
    return first_rows(df, [key], [F.col(ts).desc(), *[F.col(t) for t in ties]], n)


def most_common(df: DataFrame, column: str, k: int = 1) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column).limit(k)


def rank_moves(before: DataFrame, after: DataFrame, key: str, item: str, smallest: int = 2, k: int = 3) -> DataFrame:
    """Items in both lists whose position changed by at least ``smallest``; the k largest moves per key."""
    both = before.select(key, item, F.col("rank").alias("rank_before")).join(
        after.select(key, item, F.col("rank").alias("rank_after")), [key, item]
    )
    moved = both.withColumn("move", F.col("rank_before") - F.col("rank_after")).where(F.abs("move") >= smallest)
    return first_rows(moved, [key], [F.abs("move").desc(), F.col(item)], k, "place")


def ordered_split(df: DataFrame, order: Sequence[str], train_share: float = 0.8) -> DataFrame:
    """Adds is_train: the first floor(n * share) rows in order. The order must be unique."""
    numbered = running(df, order, {"row_no": F.lit(1)}, totals=True)
    return numbered.withColumn(
        "is_train", F.col("row_no") <= F.floor(F.col("row_no_total") * F.lit(train_share))
    ).drop("row_no", "row_no_total")


def hash_number(*parts: Column, digits_from: int = 1) -> Column:
    """A non-negative number below 2**60, uniform over rows and independent of the partitioning; digits_from is 1 to 18."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), digits_from, HASH_DIGITS), 16, 10).cast("long")


def random_split(df: DataFrame, keys: Sequence[str], seed: int = 42, train_percent: int = 80) -> DataFrame:
    return df.withColumn("is_train", hash_number(*[F.col(k) for k in keys], F.lit(seed)) % 100 < train_percent)


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (all, if fewer): those with the smallest hashes of a unique key.

    Only rows below a hash limit expected to keep somewhat more than n are ranked, over ranges and not in one task;
    should the limit keep too few, all rows are ranked.
    """
    hashed = df.withColumn("_h", hash_number(F.col(key), F.lit(seed)))
    total = df.count()
    if total > n:
        limit = int(16**HASH_DIGITS * ((n + 6 * n**0.5 + 10) / total)) + 1
        likely = hashed.where(F.col("_h") < limit)
        if likely.count() >= n:
            hashed = likely
    return running(hashed, ["_h", key], {"_no": F.lit(1)}).where(F.col("_no") <= n).drop("_h", "_no")


def latest(df: DataFrame, keys: Sequence[str], ts: str, tie: str) -> DataFrame:
    """The last record per key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("r")).select(*keys, "r.*")


def recent_categories(interactions: DataFrame, products: DataFrame, n: int = 10, k: int = 3) -> DataFrame:
    """The k most frequent categories among each user's last n rows."""
    rows = recent(interactions.select("user_id", "product_id", "session_id", "line", "ts"), "user_id", n, ties=["session_id", "product_id", "line"])
    counted = rows.join(products.select("product_id", "category"), "product_id").groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("n"))
    return first_rows(counted, ["user_id"], [F.col("n").desc(), F.col("category")], k)


def nearest_percentiles(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Sorted value number floor(q*n) for each reported percentile; for groups of at most ten values they are null."""
    found = exact_quantiles(df, value, PERCENTILES, by, nearest=True)
    return found.withColumns({p: F.when(F.col("n_values") > MIN_SAMPLE, F.col(p)) for p in PERCENTILES})


def list_changes(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that only one of two lists holds, from one full join."""
    old, new = before.select(*keys, F.lit(1).alias("_old")), after.select(*keys, F.lit(1).alias("_new"))
    both = old.join(new, list(keys), "full").where(F.col("_old").isNull() | F.col("_new").isNull())
    return both.select(*keys, F.when(F.col("_old").isNull(), "added").otherwise("removed").alias("change"))


def overlap(left: DataFrame, right: DataFrame, key: str, item: str) -> DataFrame:
    """Per key: length of the left list, common items, and their share of it."""
    marked = left.select(key, item).join(right.select(key, item, F.lit(1).alias("both")), [key, item], "left")
    return marked.groupBy(key).agg(F.count(F.lit(1)).alias("length"), F.count("both").alias("common")).withColumn(
        "share", F.col("common") / F.col("length")
    )


def foreign_values(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Distinct values outside the allowed ones."""
    return df.select(column).where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed)).distinct()
