"""Market baskets: extraction, co-occurrence, association measures, itemsets and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoplens.functions.blocks import listed_pairs, pair_counts, rank_rows, sized_pair_counts, with_sizes
from shoplens.schemas import BASKET_TYPES
from shoplens.session import shared_folder


def extract(interactions: DataFrame, types: list[str] | None = None, key: str = "user_id") -> DataFrame:
    """Distinct (basket, item, basket_size) rows of baskets with more than one item.

    Pairs, frequencies and totals all read them, so they are computed at once and kept in the shared folder.
    """
    shared_folder(interactions.sparkSession)
    kept = (
        interactions.where(F.col("interaction_type").isin(types or BASKET_TYPES))
        .select(F.col(key).alias("basket"), F.col("product_id").alias("item"))
        .distinct()
    )
    return with_sizes(kept, "basket", "item", smallest=2).checkpoint()


def frequencies(baskets: DataFrame) -> DataFrame:
    return baskets.groupBy("item").agg(F.count(F.lit(1)).alias("frequency"))


def basket_total(baskets: DataFrame) -> Column:
    return baskets.agg(F.countDistinct("basket").alias("n")).scalar()


def cooccurrence(baskets: DataFrame, smallest: int = 2, largest: int | None = None) -> DataFrame:
    """Unordered pair counts (a < b) over baskets of at least ``smallest`` items. A caller may set an upper size; larger
    baskets then do not count by definition."""
    if largest is not None:
        return listed_pairs(baskets, "basket", "item", largest, smallest)
    return sized_pair_counts(baskets.where(F.col("basket_size") >= smallest), "basket", "item")


def mirrored(pairs: DataFrame) -> DataFrame:
    """Both directions of every pair as (item_id, other_id, ...)."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    return pairs.select(F.col("a").alias("item_id"), F.col("b").alias("other_id"), *rest).unionByName(
        pairs.select(F.col("b").alias("item_id"), F.col("a").alias("other_id"), *rest)
    )


def associations(baskets: DataFrame, pairs: DataFrame, min_together: int = 2) -> DataFrame:
    """Directed rows with jaccard, lift and confidence for pairs bought together often enough.

    Item frequencies are attached to the unordered pairs, half the rows of the mirrored result.
    """
    freq = frequencies(baskets)
    n = basket_total(baskets)
    both = (
        pairs.where(F.col("together") >= min_together)
        .join(freq.select(F.col("item").alias("a"), F.col("frequency").alias("fa")), "a")
        .join(freq.select(F.col("item").alias("b"), F.col("frequency").alias("fb")), "b")
    )
    measured = both.withColumns(
        {
            "jaccard": F.col("together") / (F.col("fa") + F.col("fb") - F.col("together")),
            "lift": (F.col("together") / n) / ((F.col("fa") / n) * (F.col("fb") / n)),
        }
    )
    shape = ["together", "jaccard", "lift"]
    forward = measured.select(
        F.col("a").alias("item_id"), F.col("b").alias("other_id"), *shape, (F.col("together") / F.col("fa")).alias("confidence")
    )
    backward = measured.select(
        F.col("b").alias("item_id"), F.col("a").alias("other_id"), *shape, (F.col("together") / F.col("fb")).alias("confidence")
    )
    return forward.unionByName(backward)


def jaccard(baskets: DataFrame, pairs: DataFrame, min_together: int = 2) -> DataFrame:
    return associations(baskets, pairs, min_together).select("item_id", "other_id", F.col("jaccard").alias("score"))


def top_partners(scores: DataFrame, k: int = 10, score: str = "score") -> DataFrame:
    """The k best partners per item by score, ties to the smaller id."""
    return rank_rows(scores, "item_id", "other_id", k, score)


def frequent_itemsets(baskets: DataFrame, min_support: float = 0.01, largest: int = 3) -> DataFrame:
    """Itemsets of up to ``largest`` items found in at least int(min_support * baskets) baskets, at least one.

    Level by level: a set of k items is counted only where its parts are frequent, by equi-joins of the occurrences
    of its first k - 1 items with the baskets that hold the last one. (The library's FP-growth cannot stop at a size
    and enumerates every larger set as well.)
    """
    shared_folder(baskets.sparkSession)
    n = baskets.agg(F.countDistinct("basket").alias("n")).first()["n"]
    needed = max(int(min_support * n), 1)
    ones = frequencies(baskets).where(F.col("frequency") >= needed)
    rows = baskets.select("basket", "item").join(ones.select("item"), "item", "left_semi").checkpoint()
    out = ones.select(F.array("item").alias("items"), F.col("frequency").alias("freq"))
    if largest < 2:
        return out
    twos = pair_counts(rows, "basket", "item").where(F.col("together") >= needed)
    level = twos.select(F.array("a", "b").alias("items"), F.col("together").alias("freq")).checkpoint()
    out = out.unionByName(level)
    found = rows.select("basket", F.array("item").alias("items"))
    candidates = level.select(F.slice("items", 1, 1).alias("items"), F.col("items")[1].alias("item"))
    for size in range(3, largest + 1):
        found = _occurrences(found, candidates, rows)
        candidates = _candidates(level, size)
        counted = _occurrences(found, candidates, rows).groupBy("items").agg(F.count(F.lit(1)).alias("freq"))
        level = counted.where(F.col("freq") >= needed).checkpoint()
        out = out.unionByName(level)
    return out


def _candidates(level: DataFrame, size: int) -> DataFrame:
    """Sets of ``size`` items whose first and last parts are frequent, as (items without the last, the last item)."""
    prefix = F.slice("items", 1, size - 2)
    left = level.select(prefix.alias("prefix"), F.element_at("items", -1).alias("last"), "items")
    right = level.select(prefix.alias("prefix"), F.element_at("items", -1).alias("item"))
    grown = left.join(right, "prefix").where(F.col("last") < F.col("item"))
    tail = F.concat(F.slice("items", 2, size - 2), F.array("item"))
    return grown.withColumn("tail", tail).join(level.select(F.col("items").alias("tail")), "tail", "left_semi").select("items", "item")


def _occurrences(found: DataFrame, candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """Baskets that hold a candidate, given those that hold its first items."""
    return found.join(candidates, "items").join(rows, ["basket", "item"]).select(
        "basket", F.concat("items", F.array("item")).alias("items")
    )


def profile(baskets: DataFrame, rules: DataFrame, k: int = 10) -> DataFrame:
    """Per item: frequency, support and its k most frequent companions with their measures."""
    n = basket_total(baskets)
    top = rules.withColumn(
        "rank",
        F.row_number().over(W.partitionBy("item_id").orderBy(F.col("together").desc(), F.col("other_id"))),
    ).where(F.col("rank") <= k)
    freq = frequencies(baskets).select(F.col("item").alias("item_id"), "frequency", (F.col("frequency") / n).alias("support"))
    return freq.join(top, "item_id", "left")


def recommend(current: DataFrame, scores: DataFrame, k: int = 10) -> DataFrame:
    """For every current basket (basket, item): items with the largest summed score, none of the basket's own."""
    wanted = (
        current.select("basket", F.col("item").alias("item_id")).distinct()
        .join(scores, "item_id")
        .groupBy("basket", "other_id")
        .agg(F.round(F.sum("score"), 6).alias("score"))
    )
    own = current.select("basket", F.col("item").alias("other_id")).distinct()
    fresh = wanted.join(own, ["basket", "other_id"], "left_anti")
    return rank_rows(fresh, "basket", "other_id", k)


def shared_buyers(interactions: DataFrame, types: list[str] | None = None, min_shared: int = 2) -> DataFrame:
    """Jaccard over the user sets of two items, every user counted whatever the number of items.

    Items with fewer than ``min_shared`` users cannot reach the threshold and leave before pairs are counted.
    """
    kept = (
        interactions.where(F.col("interaction_type").isin(types or BASKET_TYPES))
        .select(F.col("user_id").alias("basket"), F.col("product_id").alias("item"))
        .distinct()
    )
    freq = frequencies(kept).where(F.col("frequency") >= min_shared)
    able = kept.join(freq.select("item"), "item", "left_semi")
    pairs = pair_counts(able, "basket", "item").where(F.col("together") >= min_shared)
    scored = (
        pairs.join(freq.select(F.col("item").alias("a"), F.col("frequency").alias("fa")), "a")
        .join(freq.select(F.col("item").alias("b"), F.col("frequency").alias("fb")), "b")
        .select("a", "b", (F.col("together") / (F.col("fa") + F.col("fb") - F.col("together"))).alias("score"))
    )
    return mirrored(scored)
