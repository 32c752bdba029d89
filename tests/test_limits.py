"""Cases that a cap, a null key or a rounding would lose."""

import datetime

import pytest
from pyspark.sql import functions as F

from shoplens.functions.ordered import carry_forward, exact_quantiles, running
from shoplens.functions.scalars import exact_mean
from shoplens.operators import baskets, featuretable, ordering, pairfeatures, recommend
from shoplens.sources.tables import Shop
from shoplens.streaming.features import user_sessions


def test_negatives_reach_their_number(spark):
    rows = [(u, i) for u in range(10) for i in range(10) if (u + i) % 5]
    seen = spark.createDataFrame(rows, "user_id long, product_id long")
    found = pairfeatures.negatives(seen).collect()
    assert len(rows) == 80 and len(found) == 160 and not {(r.user_id, r.product_id) for r in found} & set(rows)
    full = spark.createDataFrame([(u, i) for u in range(3) for i in range(3)], "user_id long, product_id long")
    with pytest.raises(ValueError, match="no pair"):
        pairfeatures.negatives(full)


def test_large_baskets_count(spark):
    rows = spark.createDataFrame([(b, i, "purchase") for b in range(3) for i in range(60)], "user_id long, product_id long, interaction_type string")
    found = baskets.extract(rows)
    pairs = baskets.cooccurrence(found)
    assert pairs.count() == 1770 and {r.together for r in pairs.select("together").distinct().collect()} == {3}
    assert baskets.cooccurrence(found, largest=50).count() == 0


def test_small_values_are_not_rounded(spark):
    df = spark.createDataFrame([(0.004,), (0.004,)], "x double")
    assert df.select(exact_mean("x")).first()[0] == pytest.approx(0.004)


def test_small_groups_keep_their_row(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(5)] + [(None, float(i)) for i in range(20)], "g string, v double")
    rows = {r.g: r for r in ordering.nearest_percentiles(df, "v", ["g"]).collect()}
    assert rows["a"].n_values == 5 and rows["a"].p50 is None and rows[None].p50 == 10.0


def test_null_groups_stay(spark):
    df = spark.createDataFrame([("a", 1, 1.0), (None, 2, 3.0), (None, 1, 5.0), (None, 3, None)], "g string, k long, v double")
    assert {(r.g, r.median) for r in exact_quantiles(df, "v", {"median": 0.5}, ["g"]).collect()} == {("a", 1.0), (None, 4.0)}
    assert sorted((str(r.g), r.k, r.s) for r in running(df, ["k"], {"s": F.lit(1)}, by=["g"]).collect()) == [("None", 1, 1), ("None", 2, 2), ("None", 3, 3), ("a", 1, 1)]
    assert sorted((str(r.g), r.k, r.last) for r in carry_forward(df, ["g"], ["k"], "v", "last").collect())[2] == ("None", 3, 3.0)


@pytest.fixture(scope="module")
def shop_rows(spark):
    day = datetime.datetime(2001, 11, 1)
    products = spark.createDataFrame(
        [(1, "c1", "b1", 10.0, 4.0, 3), (2, "c1", None, 20.0, 4.0, 3), (3, None, None, 30.0, 4.0, 3)],
        "product_id long, category string, brand string, price double, rating double, review_count int",
    )
    interactions = spark.createDataFrame(
        [(1, p, "purchase", day, 3.0, 5, 5) for p in (1, 2, 3, 3)],
        "user_id long, product_id long, interaction_type string, ts timestamp, rating double, dwell_time int, scroll_depth int",
    )
    users = spark.createDataFrame([(1, 30, "low", "c1"), (2, 31, "low", "c1"), (3, 32, None, "empty"), (4, 33, None, None)], "user_id long, age int, income_level string, preference_category string")
    return users, products, interactions


def test_null_brands_and_categories_stay(shop_rows):
    _, products, interactions = shop_rows
    assert {r.product_id: r.brand_popularity for r in pairfeatures.item_block(products, interactions).collect()} == {1: 0.25, 2: 0.75, 3: 0.75}
    assert featuretable.season_and_share(interactions, products).count() == 3


def test_cold_lists_are_filled(shop_rows):
    users, products, interactions = shop_rows
    now = F.lit("2001-12-01").cast("timestamp")
    found = recommend.cold_start(users, interactions, products, now, k=3).orderBy("user_id", "rank").collect()
    assert [(r.user_id, r.product_id) for r in found] == [(2, 1), (2, 2), (2, 3), (3, 3), (3, 1), (3, 2), (4, 3), (4, 1), (4, 2)]


def test_pairs_without_features_stay(spark, shop_rows):
    users, products, interactions = shop_rows
    blocks = pairfeatures.user_block(users, interactions, products), pairfeatures.item_block(products, interactions)
    factors = spark.createDataFrame([(1, [1.0, 2.0])], "id long, vector array<double>")
    pairs = spark.createDataFrame([(1, 1), (9, 1), (1, 9)], "user_id long, product_id long")
    found = pairfeatures.pair_table(pairs, *blocks, factors, factors, F.lit("2001-12-01").cast("timestamp")).collect()
    assert len(found) == 3 and all(r.avg_rating_given is not None and r.price is not None for r in found)


def test_users_follow_the_table(spark):
    shop = Shop(spark, "/root/testdata/sf0.1")
    assert shop.user_factors.count() == 400 and shop.item_factors.count() == 1600
    ids = [r.id for r in shop.item_factors.select("id").orderBy("id").collect()]
    assert ids == list(range(1600))


def test_a_pause_of_exactly_the_gap_goes_on(spark):
    start = datetime.datetime(2024, 1, 1)
    times = [0, 30, 60, 91]
    events = spark.createDataFrame([(1, start + datetime.timedelta(minutes=m), "view", 1.0) for m in times], "user_id long, ts timestamp, event_type string, dwell_time double")
    assert sorted(r.events for r in user_sessions(events).collect()) == [1, 3]


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from shoplens.session import shared_folder

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session)
