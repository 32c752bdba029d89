"""Joins of facts with dimensions, ranked lists and id maps. Join strategies are left to Catalyst and AQE, which see
the sizes; no side is forced to broadcast. Facts are reduced before a join wherever the result allows it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.functions.ordered import dense_index

USER_COLUMNS = ["age", "gender", "location", "income_level", "preference_category"]
PRODUCT_COLUMNS = ["category", "brand", "price", "discount_percentage", "rating", "stock_quantity"]


def attach_stats(dimension: DataFrame, stats: DataFrame, key: str, zero: Sequence[str]) -> DataFrame:
    """Left join of per-key statistics, zero where a key has none."""
    return dimension.join(stats, key, "left").fillna(0, subset=list(zero))


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def with_dimensions(
    facts: DataFrame, users: DataFrame, products: DataFrame,
    user_columns: Sequence[str] = USER_COLUMNS, product_columns: Sequence[str] = PRODUCT_COLUMNS,
) -> DataFrame:
    """Interactions with the wanted user and product columns, prefixed so that no two columns share a name."""
    who = prefixed(users.select("user_id", *user_columns), "user_", keep=["user_id"])
    what = prefixed(products.select("product_id", *product_columns), "product_", keep=["product_id"])
    return facts.join(who, "user_id", "left").join(what, "product_id", "left")


def attach_group(facts: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Group statistics joined back to every row. Unlike a window this keeps a hot group splittable."""
    return facts.join(stats, key, "left")


def enrich(ranked: DataFrame, products: DataFrame, item: str = "item_id") -> DataFrame:
    """Names and prices for ranked items, descriptions cut to 100 characters."""
    details = products.select(
        F.col("product_id").alias(item), "name", "category", "brand", "price", F.col("rating").alias("product_rating"),
        F.concat(F.substring("description", 1, 100), F.lit("...")).alias("summary"),
    )
    return ranked.join(details, item, "left")


def index_maps(interactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    return dense_index(interactions, "user_id", "user_idx"), dense_index(interactions, "product_id", "item_idx")


def to_indices(interactions: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Interactions whose user and item are both mapped, with their indices."""
    return interactions.join(users, "user_id").join(items, "product_id")


def unmatched(interactions: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """How many interactions to_indices drops; pairs are counted before the joins."""
    counted = interactions.groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("n"))
    kept = counted.join(users, "user_id", "left").join(items, "product_id", "left")
    return kept.agg(
        F.sum("n").alias("interactions"),
        F.coalesce(F.sum(F.when(F.col("user_idx").isNull() | F.col("item_idx").isNull(), F.col("n"))), F.lit(0)).alias("dropped"),
    )


def exclude_seen(candidates: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    return candidates.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def restrict(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def align(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    """Full join of two relations on their keys with left, right and right minus left of every value column.

    ``values`` maps a column name to the name used for its three result columns.
    """
    a = left.select(*keys, *[F.col(c).alias(f"{n}_left") for c, n in values.items()])
    b = right.select(*keys, *[F.col(c).alias(f"{n}_right") for c, n in values.items()])
    return a.join(b, list(keys), "full_outer").withColumns(
        {f"{n}_change": F.col(f"{n}_right") - F.col(f"{n}_left") for n in values.values()}
    )


def with_parent(categories: DataFrame) -> DataFrame:
    """Every second-level category next to its parent."""
    child, parent = categories.alias("c"), categories.alias("p")
    return child.where("level = 2").join(
        parent, F.col("c.parent_category") == F.col("p.category_id"), "left"
    ).select("c.category_id", F.col("c.name").alias("name"), F.col("p.category_id").alias("parent_id"), F.col("p.name").alias("parent_name"))
