"""Recommendation lists for all users at once, their description, and cold-start and experiment reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.functions.blocks import DIGITS, best_matches
from shoplens.functions.scalars import count_text, exact_mean, lookup, type_count
from shoplens.operators.joins import align, enrich
from shoplens.operators.ordering import first_rows, hash_number, list_changes, recent
from shoplens.schemas import FUNNEL_WEIGHTS

HIGH_RATING = 4.0


def personal(users: DataFrame, items: DataFrame, k: int = 10, seen: DataFrame | None = None) -> DataFrame:
    """Best k items per user by inner product; pairs of ``seen`` (user_id, product_id) are left out."""
    skip = seen.select(F.col("user_id").alias("id"), F.col("product_id").alias("other")) if seen is not None else None
    found = best_matches(users, items, k, skip=skip)
    return found.select(F.col("id").alias("user_id"), F.col("other").alias("product_id"), "score", "rank")


def two_stage(users: DataFrame, items: DataFrame, score_pairs, products: DataFrame, candidates: int = 100, k: int = 10) -> DataFrame:
    """Candidates by inner product, scored by ``score_pairs`` (DataFrame -> DataFrame adding 'prediction'), best k enriched."""
    pool = personal(users, items, candidates).select("user_id", "product_id", F.col("score").alias("retrieval_score"))
    scored = pool.transform(score_pairs).select("user_id", "product_id", "retrieval_score", F.round("prediction", DIGITS).alias("prediction"))
    best = first_rows(scored, ["user_id"], [F.col("prediction").desc(), F.col("product_id")], k)
    return enrich(best, products, "product_id")


def history(users: DataFrame, interactions: DataFrame, products: DataFrame, n: int = 5) -> DataFrame:
    """Demographics, interaction breakdown and the names of the last n products, one row per user."""
    counts = interactions.groupBy("user_id", "interaction_type").agg(F.count(F.lit(1)).alias("n"))
    breakdown = counts.groupBy("user_id").agg(
        F.sum("n").alias("total_interactions"),
        count_text(F.collect_list(F.struct(F.col("interaction_type").alias("k"), "n"))).alias("breakdown"),
    )
    rows = recent(interactions.select("user_id", "product_id", "session_id", "line", "ts"), "user_id", n, ties=["session_id", "product_id", "line"])
    named = rows.join(products.select("product_id", "name"), "product_id", "left").groupBy("user_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda e: e["name"]), "; ").alias("last_products")
    )
    return users.join(breakdown, "user_id", "left").join(named, "user_id", "left")


def list_statistics(ranked: DataFrame, products: DataFrame) -> DataFrame:
    """Price range, mean rating, share of well-rated items and category counts of every user's list."""
    described = ranked.select("user_id", "product_id").join(products.select("product_id", "price", "rating", "category"), "product_id")
    per_category = described.groupBy("user_id", "category").agg(
        F.count(F.lit(1)).alias("n"), F.min("price").alias("low"), F.max("price").alias("high"),
        F.sum(F.col("price").cast("decimal(18,2)")).alias("price_sum"), F.sum(F.col("rating").cast("decimal(18,2)")).alias("rating_sum"),
        F.count_if(F.col("rating") >= HIGH_RATING).alias("good"),
    )
    return per_category.groupBy("user_id").agg(
        F.sum("n").alias("items"), F.min("low").alias("min_price"), F.max("high").alias("max_price"),
        (F.sum("price_sum").cast("double") / F.sum("n")).alias("avg_price"), (F.sum("rating_sum").cast("double") / F.sum("n")).alias("avg_rating"),
        (F.sum("good") / F.sum("n")).alias("high_quality_share"),
        count_text(F.collect_list(F.struct(F.col("category").alias("k"), "n"))).alias("categories"),
    )


def price_match(statistics: DataFrame, interactions: DataFrame, products: DataFrame) -> DataFrame:
    """Deviation of a list's mean price from the user's historical mean, in three bands."""
    pairs = interactions.groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("n"))
    past = pairs.join(products.select("product_id", "price"), "product_id").groupBy("user_id").agg(
        (F.sum(F.col("price").cast("decimal(18,2)") * F.col("n")).cast("double") / F.sum("n")).alias("historical_price")
    )
    gap = F.abs(F.col("avg_price") - F.col("historical_price")) / F.col("historical_price")
    return statistics.select("user_id", "avg_price").join(past, "user_id").withColumn("deviation", gap).withColumn(
        "price_match", F.when(F.col("deviation") < 0.2, "excellent").when(F.col("deviation") < 0.4, "good").otherwise("poor")
    )


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Items that entered, left or stayed between two lists of each user, with both scores and their difference."""
    kept = align(before, after, ["user_id", "product_id"], {"score": "score"})
    return kept.withColumn(
        "change", F.when(F.col("score_left").isNull(), "added").when(F.col("score_right").isNull(), "removed").otherwise("kept")
    )


def session_categories(interactions: DataFrame, products: DataFrame) -> DataFrame:
    pairs = interactions.groupBy("session_id", "product_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(products.select("product_id", "category"), "product_id").groupBy("session_id", "category").agg(F.sum("n").alias("n"))


def decayed_popularity(interactions: DataFrame, as_of: Column, half_life_days: float = 180.0) -> DataFrame:
    """Per product: type weights halved every ``half_life_days``. Rows are counted per day before the weights apply."""
    weight = F.coalesce(lookup(F.col("interaction_type"), FUNNEL_WEIGHTS), F.lit(0.0))
    daily = interactions.groupBy("product_id", "interaction_type", F.date_diff(as_of, F.col("ts")).alias("age")).agg(F.count(F.lit(1)).alias("n"))
    decay = F.exp(F.lit(-0.6931471805599453) * F.col("age") / F.lit(half_life_days))
    return daily.groupBy("product_id").agg(F.round(F.sum(F.col("n") * weight * decay), DIGITS).alias("score"))


def cold_start(users: DataFrame, interactions: DataFrame, products: DataFrame, as_of: Column, min_history: int = 1, k: int = 10) -> DataFrame:
    """For users with less than ``min_history`` interactions: the k most popular items of their preferred category, filled
    up from the whole shop when it has fewer or there is none. Lists are made per category; only k rows of each meet the users."""
    popular = decayed_popularity(interactions, as_of).join(products.select("product_id", F.col("category").alias("own")), "product_id")
    order = [F.col("score").desc(), F.col("product_id")]
    best = first_rows(popular.where(F.col("own").isNotNull()), ["own"], order, k).select(F.col("own").alias("category"), "product_id", "score", F.lit(0).alias("_fill"))
    everywhere = popular.orderBy(*order).limit(k).agg(F.collect_list(F.struct("product_id", "score", "own")).alias("top")).scalar()
    cold = users.select("user_id", F.coalesce("preference_category", F.lit("*")).alias("category"))
    cold = cold.join(interactions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_history), "user_id", "left_anti")
    wanted = cold.select("category").distinct()
    fill = wanted.select("category", F.explode(everywhere).alias("t")).where(~F.col("category").eqNullSafe(F.col("t.own")))
    fill = fill.select("category", "t.product_id", "t.score", F.lit(1).alias("_fill"))
    lists = best.join(wanted, "category", "left_semi").unionByName(fill)
    lists = first_rows(lists, ["category"], [F.col("_fill"), *order], k).drop("_fill")
    return cold.join(lists, "category")


def experiment(events: DataFrame, arms: int = 2, salt: str = "exp") -> DataFrame:
    """Click and conversion rates per arm of a hash-assigned experiment, their standard errors and z against arm 0."""
    per_user = events.groupBy("user_id").agg(
        *[type_count("event_type", t).alias(t) for t in ("view", "click", "purchase")]
    )
    groups = per_user.withColumn("arm", hash_number(F.col("user_id"), F.lit(salt)) % arms).groupBy("arm").agg(
        F.count(F.lit(1)).alias("users"), *[F.sum(t).alias(t) for t in ("view", "click", "purchase")]
    )
    base = groups.where("arm = 0").select(F.struct("view", "click", "purchase").alias("b")).scalar()
    out = groups.withColumn("_b", base)
    for name, hit, n in (("ctr", "click", "view"), ("conversion", "purchase", "click")):
        p, p0 = F.col(hit) / F.col(n), F.col(f"_b.{hit}") / F.col(f"_b.{n}")
        pooled = (F.col(hit) + F.col(f"_b.{hit}")) / (F.col(n) + F.col(f"_b.{n}"))
        spread = F.sqrt(F.abs(pooled * (F.lit(1.0) - pooled)) * (F.lit(1.0) / F.col(n) + F.lit(1.0) / F.col(f"_b.{n}")))
        out = out.withColumns(
            {
                name: p,
                f"{name}_se": F.sqrt(F.abs(p * (F.lit(1.0) - p)) / F.col(n)),
                f"{name}_z": F.when(spread > 0, (p - p0) / spread),
            }
        )
    return out.drop("_b")
