import datetime as dt

import pytest
from pyspark.sql import functions as F

from shoplens import schemas
from shoplens.functions.scalars import price_tier
from shoplens.operators import cleaning as C
from shoplens.operators import encoders as E
from shoplens.operators import quality as Q
from shoplens.sources import sinks
from shoplens.sources.tables import read_table

NOW = "2024-01-31 12:00:00"
USERS = "user_id long, age int, gender string, location string, income_level string, preference_category string, email string, created_at string, last_active string"
DIRTY = [
    (1, 20, None, " new-york ", None, " Books ", "  A@B.Com ", "2024-01-01 00:00:00", "2024-01-30 13:00:00"),
    (2, None, "male", None, "low", "Toys", "c@d.com", "garbage", "2024-01-01 11:59:59"),
    (3, 31, "female", "los angeles", "high", "Toys", "c@d.com", "2023-01-31 12:00:00", "2024-01-01 12:00:01"),
]


def test_users(spark):
    out = {r.user_id: r for r in C.clean_users(spark.createDataFrame(DIRTY, USERS), F.lit(NOW).cast("timestamp")).collect()}
    assert out[2].age == 25.5  # median of 20 and 31
    assert (out[1].gender, out[1].income_level, out[2].location) == ("unknown", "medium", "Unknown")
    assert (out[1].location, out[3].location) == ("New-York", "Los Angeles")
    assert (out[1].email, out[1].preference_category) == ("a@b.com", "Books")
    assert out[2].created_at is None and out[2].days_since_created is None
    assert out[1].days_since_active == 0  # 23 hours are no full day
    assert (out[2].days_since_active, out[2].is_active) == (30, True)
    assert (out[3].days_since_active, out[3].is_active) == (29, True)
    assert out[3].days_since_created == 365


def test_products(spark):
    rows = [(1, None, 3.0, 0.0), (2, "12x", 3.0, 0.0), (3, "0", 3.0, 0.0), (4, "-1", 3.0, 0.0), (5, "50", 5.1, 0.0), (6, "100", None, 100.0)]
    df = spark.createDataFrame(rows, "product_id long, price string, rating double, discount_percentage double").withColumns(
        {"review_count": F.lit(None).cast("int"), "stock_quantity": F.lit(1)}
    )
    out = {r.product_id: r for r in C.clean_products(df).collect()}
    assert set(out) == {1, 2, 6}  # 3 and 4 have no positive price, 5 no valid rating
    assert out[1].price == out[2].price == 25.0  # median of 0, -1, 50, 100
    assert out[6].rating == 3.0 and out[6].final_price == 0.0 and out[6].has_discount and out[1].review_count == 0


def test_interactions(spark):
    rows = [(1, None, 2, "2024-01-07 23:59:00"), (2, 3.0, 0, "2024-01-08 00:00:00"), (3, 6.0, 1, "2024-01-08 00:00:00"), (4, 4.0, None, "2024-01-08 00:00:00")]
    df = spark.createDataFrame(rows, "k long, rating double, quantity int, ts string")
    out = {r.k: r for r in C.clean_interactions(df).collect()}
    assert set(out) == {1, 4}
    assert (out[1].rating, out[1].day_of_week, out[1].is_weekend, out[1].hour_of_day) == (0.0, 6, True, 23)
    assert (out[4].quantity, out[4].day_of_week, out[4].is_weekend) == (1, 0, False)
    explicit = {r.k: r.rating for r in C.clean_interactions(df, rating_policy="explicit").collect()}
    assert explicit == {1: None, 4: 4.0}


def test_price_bands_are_right_closed(spark):
    prices = [0.0, 0.01, 50.0, 50.01, 200.0, 500.0, 1000.0, 1000.01]
    got = [r.b for r in spark.createDataFrame([(p,) for p in prices], "p double").select(price_tier(F.col("p")).alias("b")).collect()]
    assert got == [None, "budget", "budget", "affordable", "affordable", "mid-range", "premium", "luxury"]


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None)], "k long, v double")
    out = {r.k: r.v_scaled for r in E.apply_scaler(df, E.fit_scaler(df, ["v"]), ["v"]).collect()}
    assert out == {1: 0.0, 2: 0.0, 3: None}


def test_labels_are_alphabetical_and_name_the_missing(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "zz")], "k long, c string")
    assert {r.k: r.c_encoded for r in E.encode_labels(df, ["c"]).collect()} == {3: 0, 1: 1, 2: 2, 4: 3}


def rules(df, *wanted):
    return {r.rule: r.failures for r in Q.evaluate(df, "t", wanted).collect()}


def test_rules(spark):
    df = spark.createDataFrame([(1, 12, "male"), (1, 101, None), (2, None, "MALE"), (3, 13, "x")], "id long, age int, gender string")
    got = rules(
        df, Q.Rule("unique", "id"), Q.Rule("between", "age", 13, 100), Q.Rule("between", "age", 13, 100, allow_null=True),
        Q.Rule("in_set", "gender", values=("male",)), Q.Rule("lower_in_set", "gender", values=("male",)), Q.Rule("not_null", "age"),
        Q.Rule("columns", values=("id", "age", "gender")),
    )
    assert got == {"unique:id": 1, "between:age": 2, "in_set:gender": 3, "lower_in_set:gender": 2, "not_null:age": 1, "columns": 0}


def test_empty_table_passes_and_missing_column_fails(spark):
    empty = spark.createDataFrame([], "id long")
    rows = Q.evaluate(empty, "t", [Q.Rule("between", "id", 1), Q.Rule("not_null", "other")]).collect()
    assert {r.rule: r.success for r in rows} == {"between:id": True, "not_null:other": False}


def test_strict_mode_raises(spark):
    rows = Q.evaluate(spark.createDataFrame([(None,)], "id long"), "t", [Q.Rule("not_null", "id")])
    with pytest.raises(ValueError):
        Q.require(Q.summarise(rows))


def test_csv_round_trip_keeps_arrays_and_missing_table_is_an_error(spark, tmp_path):
    row = (1, "n", "d", "c", "s", "b", 1.5, 0.0, 3, 4.0, 2, 0.0, 1.0, "x", "red", "L", "in_stock", "u", ["a", "b,c"], dt.datetime(2024, 1, 1))
    df = spark.createDataFrame([row], schemas.PRODUCTS)
    sinks.write_table(df, str(tmp_path), "products", fmt="csv")
    back = read_table(spark, str(tmp_path), "products", schemas.PRODUCTS).first()
    assert back.tags == ["a", "b,c"] and back.price == 1.5 and back.created_at == dt.datetime(2024, 1, 1)
    with pytest.raises(FileNotFoundError):
        read_table(spark, str(tmp_path), "users", schemas.USERS)


def test_expired_days_are_dropped_and_not_read(spark, tmp_path):
    from shoplens.sources import sinks
    from shoplens.sources.tables import within_age

    folder = str(tmp_path / "daily")
    events = spark.range(0, 240).select("id", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 3600).alias("ts"))  # ten days of hours
    sinks.write_daily(events, "ts", folder)
    now = F.lit("2024-01-10 12:00:00").cast("timestamp")
    kept = within_age(spark.read.parquet(folder), "ts", now, 3, day="day")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and ">= 2024-01-07" in plan.replace("19729", "2024-01-07")
    wanted = sorted(r.id for r in within_age(events, "ts", now, 3).collect())
    assert sorted(r.id for r in kept.collect()) == wanted and len(wanted) == 84
    assert sinks.drop_expired_days(spark, folder, now, 3) == [f"2024-01-0{d}" for d in range(1, 7)]
    assert sorted(p.name for p in (tmp_path / "daily").iterdir() if "=" in p.name) == [f"day=2024-01-{d:02d}" for d in range(7, 11)]
    assert sorted(r.id for r in within_age(spark.read.parquet(folder), "ts", now, 3, day="day").collect()) == wanted


def test_report_counts_while_writing(spark):
    from shoplens.operators import cleaning as C

    rows = spark.createDataFrame([(1, "5", 2.0, 0.0), (2, "x", 3.0, 0.0), (3, "-1", 1.0, 0.0), (4, None, 9.0, 0.0)], "product_id long, price string, rating double, discount_percentage double")
    written = {}
    found = C.cleaning_report(spark, {"products": lambda seen: C.clean_products(rows, observation=seen)}, lambda name, df: written.update({name: df.count()})).first()
    assert (found.original_rows, found.cleaned_rows, written["products"]) == (4, 2, 2) and found.seconds > 0
