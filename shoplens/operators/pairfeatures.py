"""Features of (user, item) pairs for the ranker, positive and negative samples, training and inference tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.functions.ordered import dense_index
from shoplens.functions.scalars import dot, norm, weekday_flags
from shoplens.operators.aggregates import engagement, popularity
from shoplens.operators.encoders import category_code, income_code
from shoplens.operators.joins import prefixed
from shoplens.operators.ordering import hash_number
from shoplens.sources.sinks import keep, remove

# fixed values: what a pair gets when a user, an item or its factors are unknown
USER_DEFAULTS = {"avg_rating_given": 3.5, "category_diversity": 0.5, "avg_product_price": 500.0, "premium_ratio": 0.3}
PREMIUM_PRICE = 500.0
FACTOR_DEFAULTS = {
    "als_score": 0.0, "embedding_cosine": 0.0, "user_embedding_norm": 1.0, "item_embedding_norm": 1.0,
    "user_top_factor": 0.0, "item_top_factor": 0.0,
}
ITEM_DEFAULTS = {
    "price": 0.0, "item_rating": 0.0, "review_count": 0, "popularity_score": 0.0, "engagement_score": 0.0, "conversion_rate": 0.0, "brand_popularity": 0.0,
}
NEGATIVE_RATIO = 2
DRAW_RANGES = 4096


def user_block(users: DataFrame, interactions: DataFrame, products: DataFrame) -> DataFrame:
    """Age, income code, activity, mean rating given, category diversity, mean product price, premium share.

    Interactions are counted per (user, product) first, so a popular product joins one row per user.
    """
    pairs = interactions.groupBy("user_id", "product_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rating").alias("rating_sum"), F.count("rating").alias("rated")
    )
    described = pairs.join(products.select("product_id", "category", "price"), "product_id")
    n_categories = products.agg(F.countDistinct("category").alias("n")).scalar()
    stats = described.groupBy("user_id").agg(
        F.sum("n").alias("total_interactions"),
        (F.sum("rating_sum") / F.sum("rated")).alias("avg_rating_given"),
        (F.countDistinct("category") / n_categories).alias("category_diversity"),
        (F.sum(F.col("price").cast("decimal(18,2)") * F.col("n")).cast("double") / F.sum("n")).alias("avg_product_price"),
        (F.sum(F.when(F.col("price") > PREMIUM_PRICE, F.col("n")).otherwise(0)) / F.sum("n")).alias("premium_ratio"),
    )
    base = users.select("user_id", "age", income_code(F.col("income_level")).alias("income_code"), "preference_category")
    return base.join(stats, "user_id", "left").fillna({"total_interactions": 0, **USER_DEFAULTS})


def item_block(products: DataFrame, interactions: DataFrame) -> DataFrame:
    """Price, rating, reviews, popularity, engagement, conversion, category code and brand share of interactions."""
    stats = interactions.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("rating").alias("avg_rating"), F.count("rating").alias("rated"),
        F.avg("dwell_time").alias("dwell"), F.avg("scroll_depth").alias("scroll"),
        F.count_if(F.col("interaction_type") == "purchase").alias("bought"),
        F.count_if(F.col("interaction_type") == "view").alias("viewed"),
    )
    known = products.join(stats, "product_id", "left").fillna(0, subset=["n", "avg_rating", "rated", "bought", "viewed"])
    brands = known.groupBy(F.col("brand").alias("_brand")).agg(F.sum("n").alias("brand_n"))
    total = interactions.agg(F.count(F.lit(1)).alias("n")).scalar()
    return known.join(brands, F.col("brand").eqNullSafe(F.col("_brand"))).select(
        "product_id", "price", F.col("rating").alias("item_rating"), "review_count", "category",
        popularity(F.col("n"), F.col("avg_rating"), F.col("rated")).alias("popularity_score"),
        F.coalesce(engagement(F.col("dwell"), F.col("scroll")), F.lit(0.0)).alias("engagement_score"),
        F.when(F.col("viewed") > 0, F.col("bought") / F.col("viewed")).otherwise(F.lit(0.0)).alias("conversion_rate"),
        category_code(F.col("category")).alias("category_code"),
        (F.col("brand_n") / total).alias("brand_popularity"),
    )


def compatibility(pairs: DataFrame) -> DataFrame:
    """Price, rating, category and premium fit of pairs that carry both blocks."""
    premium = F.when(F.col("price") > PREMIUM_PRICE, 1.0).otherwise(0.0)
    return pairs.withColumns(
        {
            "price_compatibility": F.lit(1.0) / (F.lit(1.0) + F.abs(F.log1p("price") - F.log1p("avg_product_price"))),
            "rating_compatibility": F.lit(1.0) - F.abs(F.col("avg_rating_given") - F.col("item_rating")) / F.lit(5.0),
            "category_match": F.coalesce((F.col("preference_category") == F.col("category")).cast("double"), F.lit(0.0)),
            "premium_compatibility": F.lit(1.0) - F.abs(F.col("premium_ratio") - premium),
        }
    )


def factor_side(factors: DataFrame, key: str, name: str) -> DataFrame:
    """Per user or item its vector, and the vector's length and largest element, computed once, before the joins."""
    return factors.select(
        F.col("id").alias(key), F.col("vector").alias(f"_{name}"), norm(F.col("vector")).alias(f"_{name}_norm"),
        F.array_max("vector").cast("double").alias(f"_{name}_top"),
    )


def factor_features(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Inner product, cosine, lengths and largest elements of the factors; defaults unless both sides have them."""
    users, items = factor_side(users, "user_id", "user"), factor_side(items, "product_id", "item")
    return _factor_columns(pairs.join(users, "user_id", "left").join(items, "product_id", "left"))


def _factor_columns(joined: DataFrame) -> DataFrame:
    product = dot(F.col("_user"), F.col("_item"))
    values = {
        "als_score": product,
        "embedding_cosine": product / (F.col("_user_norm") * F.col("_item_norm") + F.lit(1e-8)),
        "user_embedding_norm": F.col("_user_norm"), "item_embedding_norm": F.col("_item_norm"),
        "user_top_factor": F.col("_user_top"), "item_top_factor": F.col("_item_top"),
    }
    known = F.col("_user").isNotNull() & F.col("_item").isNotNull()
    out = joined.withColumns({c: F.when(known, v).otherwise(F.lit(FACTOR_DEFAULTS[c])) for c, v in values.items()})
    return out.drop(*[f"_{n}{s}" for n in ("user", "item") for s in ("", "_norm", "_top")])


def request_time(df: DataFrame, as_of: Column) -> DataFrame:
    flags = weekday_flags(as_of)
    number = ["is_weekend", "is_evening", "is_morning"]
    return df.withColumns(
        {"hour_of_day": flags["hour_of_day"], "day_of_week": flags["day_of_week"], **{c: flags[c].cast("double") for c in number}}
    )


def pair_table(pairs: DataFrame, user_features: DataFrame, item_features: DataFrame, user_factors: DataFrame, item_factors: DataFrame, as_of: Column) -> DataFrame:
    """All features of every given (user_id, product_id) row; other columns of ``pairs`` are kept. Users and items without
    features get the defaults; their age, income, category and its code stay null. Features and factors of a side are joined first,
    so that pairs, of which there may be very many, are shuffled once per side."""
    users = user_features.join(factor_side(user_factors, "user_id", "user"), "user_id", "full_outer")
    items = item_features.join(factor_side(item_factors, "product_id", "item"), "product_id", "full_outer")
    joined = pairs.join(users, "user_id", "left").join(items, "product_id", "left")
    joined = joined.fillna({"total_interactions": 0, **USER_DEFAULTS, **ITEM_DEFAULTS})
    return request_time(_factor_columns(compatibility(joined)), as_of)


FEATURES = [
    "age", "income_code", "total_interactions", "avg_rating_given", "category_diversity", "avg_product_price", "premium_ratio",
    "price", "item_rating", "review_count", "popularity_score", "engagement_score", "conversion_rate", "category_code",
    "brand_popularity", "price_compatibility", "rating_compatibility", "category_match", "premium_compatibility",
    "als_score", "embedding_cosine", "user_embedding_norm", "item_embedding_norm", "user_top_factor", "item_top_factor",
    "hour_of_day", "day_of_week", "is_weekend", "is_evening", "is_morning",
]


def positives(interactions: DataFrame) -> DataFrame:
    return interactions.select("user_id", "product_id", F.lit(1).alias("label"), F.coalesce("rating", F.lit(0.0)).alias("rating"))


def negatives(interactions: DataFrame, ratio: int = NEGATIVE_RATIO, seed: int = 42) -> DataFrame:
    """ratio * interactions uniform (user, item) pairs that never interacted; repeats are possible.

    Draw number i is a hash of i and the seed, so a repeated task makes the same draws. As many are drawn as the share of
    free pairs asks for, with ten standard deviations to spare, and more if that should not do; surplus draws are cut by
    number. Raises if every pair interacted. Counts the pairs and draws while the plan is built; the pairs that interacted and
    the numbered users and items, which several steps read, are written once and removed when the draws are there.
    """
    spark = interactions.sparkSession
    counted, pairs_at = keep(interactions.groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("n")), "pairs")
    seen = counted.select("user_id", "product_id")
    users, users_at = keep(dense_index(seen, "user_id", "user_idx"), "pairs")
    items, items_at = keep(dense_index(seen, "product_id", "item_idx"), "pairs")
    n_users, n_items, (n_seen, rows) = users.count(), items.count(), counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    wanted = (rows or 0) * ratio
    if wanted and n_seen >= n_users * n_items:
        raise ValueError("every user interacted with every item: there is no pair to draw")
    tries = draw_count(wanted, n_users * n_items, n_seen)
    while True:
        at = (F.col("draw"), F.lit(seed))
        placed = spark.range(1, tries + 1).withColumnRenamed("id", "draw").withColumns(
            {"user_idx": hash_number(*at) % F.lit(max(n_users, 1)), "item_idx": hash_number(*at, digits_from=17) % F.lit(max(n_items, 1))}
        )
        drawn = placed.join(users, "user_idx").join(items, "item_idx").select("draw", "user_id", "product_id")
        fresh, fresh_at = keep(drawn.join(seen, ["user_id", "product_id"], "left_anti"), "draws")
        if fresh.count() >= wanted:
            break
        remove(spark, fresh_at)
        tries *= 2
    for path in (pairs_at, users_at, items_at):
        remove(spark, path)
    return _first(fresh, "draw", wanted, tries).select("user_id", "product_id", F.lit(0).alias("label"), F.lit(0.0).alias("rating"))


def _first(df: DataFrame, number: str, wanted: int, largest: int) -> DataFrame:
    """The ``wanted`` rows with the least of their distinct numbers, which lie evenly up to ``largest``. Numbers are counted by
    ranges, and only the range that has the last row wanted is sorted."""
    if not wanted:
        return df.limit(0)
    width, below = largest // DRAW_RANGES + 1, 0
    place = F.expr(f"{number} div {width}")
    counts = sorted(tuple(r) for r in df.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect())
    for at, n in counts:
        if below + n >= wanted:
            break
        below += n
    last = df.where(place == at).select(number).orderBy(number).limit(wanted - below).agg(F.max(number)).first()[0]
    return df.where(F.col(number) <= last)


def draw_count(wanted: int, pairs: int, seen: int) -> int:
    """Draws after which ``wanted`` of them fall on free pairs, but for ten standard deviations."""
    return math.ceil((wanted + 10 * math.sqrt(wanted) + 100) * pairs / (pairs - seen)) if wanted else 0


def training_samples(interactions: DataFrame, ratio: int = NEGATIVE_RATIO) -> DataFrame:
    return positives(interactions).unionByName(negatives(interactions, ratio))


def supervised(interactions: DataFrame, users: DataFrame, products: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Interaction rows with prefixed user and product columns, target and success flag, missing features as 0."""
    facts = interactions.withColumnRenamed("rating", "interaction_rating")
    joined = facts.join(prefixed(users, "user_", keep=["user_id"]), "user_id", "left").join(
        prefixed(products, "product_", keep=["product_id"]), "product_id", "left"
    )
    target = F.coalesce(F.col("interaction_rating"), F.lit(0.0))
    keep = [c for c in wanted if c in joined.columns]
    return joined.withColumns({"target": target, "interaction_success": (target > 0).cast("int")}).select(
        *keep, "target", "interaction_success"
    ).fillna(0, subset=keep)


def inference_table(candidates: DataFrame, users: DataFrame, products: DataFrame, as_of: Column) -> DataFrame:
    """Candidate pairs with prefixed user and product columns, neutral interaction values and clock features."""
    joined = candidates.select("user_id", "product_id").join(prefixed(users, "user_", keep=["user_id"]), "user_id").join(
        prefixed(products, "product_", keep=["product_id"]), "product_id"
    )
    neutral = {"quantity": F.lit(1), "dwell_time": F.lit(0), "scroll_depth": F.lit(0), "session_length": F.lit(1)}
    flags = weekday_flags(as_of)
    clock = {c: flags[c] for c in ("hour_of_day", "day_of_week", "is_weekend", "is_business_hours")}
    return joined.withColumns({**neutral, **clock})
