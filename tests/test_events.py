import datetime as dt
import random

from pyspark.sql import functions as F

from shoplens.operators import clickstream as C
from shoplens.operators import featuretable as T
from shoplens.operators import monitor as M
from shoplens.operators import ordering as O
from shoplens.operators import profiling as P
from shoplens.streaming import features as S
from shoplens.functions.ordered import assign_ranges
from shoplens.streaming import sinks, sources
from shoplens.streaming.keyed import SKETCH_BOUND, BucketTable, MergedTable, finished_totals, merge_totals, partial_totals

BASE = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, user_id long, product_id long, event_type string, ts timestamp, dwell_time double, scroll_depth double, device_type string, location string"


def event(i, user=1, minutes=0.0, kind="view", dwell=10.0, scroll=50.0):
    return (i, user, 1, kind, BASE + dt.timedelta(minutes=minutes), dwell, scroll, "mobile", "X")


def at(minutes):
    return F.lit((BASE + dt.timedelta(minutes=minutes)).isoformat(sep=" ")).cast("timestamp")


def test_sessions_split_on_more_than_the_gap(spark):
    rows = [event(1, 1, 0), event(2, 1, 30), event(3, 1, 60.1), event(4, 2, 5)]
    found = C.sessions(spark.createDataFrame(rows, EVENTS))
    assert sorted((r.user_id, r.events) for r in found.collect()) == [(1, 1), (1, 2), (2, 1)]
    assert {r.user_id: r.session_count for r in C.session_counts(found).collect()} == {1: 2, 2: 1}


def fold(events):
    out = {}
    for e in sorted((e for e in events if e[3] == "view"), key=lambda e: (e[4], e[0])):
        n, d = out.get(e[1], (0, 0.0))
        n += 1
        if e[5]:
            d = (d * (n - 1) + e[5]) / n
        out[e[1]] = (n, d)
    return out


def some_views(n=400):
    random.seed(3)
    return [event(i, 1 if i % 3 else i % 7, i * 1.5, random.choice(["view", "view", "click"]), random.choice([None, 0.0, 5.0, 80.0])) for i in range(n)]


def test_running_mean_equals_the_fold(spark):
    rows = some_views()
    got = {r.user_id: (r.total_views, r.avg_dwell_time) for r in C.running_means(spark.createDataFrame(rows, EVENTS)).collect()}
    for user, (n, d) in fold(rows).items():
        assert got[user][0] == n and abs(got[user][1] - d) < 1e-9


def test_means_table_over_batches_equals_the_fold(spark, tmp_path):
    rows = some_views(60)
    table = S.means_table(str(tmp_path), buckets=4)
    for part in range(3):
        table(spark.createDataFrame(rows[part * 20:part * 20 + 20], EVENTS), part)
    table(spark.createDataFrame(rows[40:], EVENTS), 2)  # the last batch once more
    got = {r.user_id: (r.total_views, r.avg_dwell_time) for r in table.read(spark).collect()}
    wanted = fold(rows)
    assert got.keys() == wanted.keys()
    for user, (n, d) in wanted.items():
        assert got[user][0] == n and abs(got[user][1] - d) < 1e-9


def test_means_start_anew_after_the_expiry(spark, tmp_path):
    table = S.means_table(str(tmp_path), buckets=2)
    table(spark.createDataFrame([event(1, 1, 0, dwell=10.0), event(2, 2, 0, dwell=10.0)], EVENTS), 0)
    late = 45 * 24 * 60
    table(spark.createDataFrame([event(3, 1, late, dwell=90.0)], EVENTS), 1)
    got = {r.user_id: (r.total_views, r.avg_dwell_time) for r in table.read(spark).collect()}
    assert got[1] == (1, 90.0)


def test_a_hot_user_s_views_are_spread_over_ranges(spark):
    """A user with a third of all views lies in about a third of the ranges, none of which holds much more than its share."""
    rows = [event(i, 1 if i % 3 == 0 else i, i) for i in range(3000)]
    ranged = assign_ranges(spark.createDataFrame(rows, EVENTS), ["user_id", "ts", "event_id"], 64)
    sizes = [r["count"] for r in ranged.where("user_id = 1").groupBy("_range").count().collect()]
    assert len(sizes) >= 12 and max(sizes) < 300


def plain_totals(rows):
    out = {}
    for e in rows:
        total = out.setdefault(e[2], [0, 0, set(), 0.0])
        total[0] += 1
        total[1] += e[3] == "view"
        total[2].add(e[1])
        total[3] += e[5] or 0.0
    return {k: (n, v, len(u), round(d, 6)) for k, (n, v, u, d) in out.items()}


def test_merged_totals_survive_compaction_and_repeated_batches(spark, tmp_path):
    random.seed(5)
    rows = [(i, random.randrange(40), random.randrange(5), random.choice(["view", "click", "purchase"]), BASE + dt.timedelta(minutes=i), random.choice([None, 1.5, 3.25]), 1.0, "mobile", "X") for i in range(600)]
    table = MergedTable(str(tmp_path), lambda df: partial_totals(df, ["product_id"], ["user_id"], {"type": F.col("event_type")}), merge_totals(["product_id"]), compact_every=3)
    for batch in range(10):
        part = spark.createDataFrame(rows[batch * 60:batch * 60 + 60], EVENTS)
        table(part, batch)
        if batch in (0, 5, 9):
            table(part, batch)  # a batch that is repeated, also one that was compacted, changes nothing
    got = finished_totals(table.read(spark), ["type"]).collect()
    wanted = plain_totals(rows)
    assert {r.product_id: (r.total_events, r.view_count, r.unique_user_id, round(r.total_dwell_time, 6)) for r in got} == wanted
    for r in got:
        counts = {}
        for e in rows:
            if e[2] == r.product_id:
                counts[e[3]] = counts.get(e[3], 0) + 1
        assert r.type_distribution == ",".join(f"{k}:{n}" for k, n in sorted(counts.items()))
    kept = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "deltas").iterdir() if "=" in p.name)
    assert kept[0] == 6 and kept[-1] == 9 and len(kept) == 4  # the last base's deltas stay for a repeat, older ones go


def test_sketch_of_many_users_keeps_its_bound(spark, tmp_path):
    table = MergedTable(str(tmp_path), lambda df: partial_totals(df, [], ["user_id"]), merge_totals([]))
    events = spark.range(60_000).select(
        F.col("id").alias("event_id"), (F.col("id") % 25_000).alias("user_id"), F.lit(1).cast("long").alias("product_id"), F.lit("view").alias("event_type"),
        F.timestamp_seconds("id").alias("ts"), F.lit(1.0).alias("dwell_time"), F.lit(1.0).alias("scroll_depth"),
    )
    for batch in range(3):
        table(events.where(F.col("event_id") % 3 == batch), batch)
    estimate = finished_totals(table.read(spark)).first().unique_user_id
    assert abs(estimate - 25_000) <= SKETCH_BOUND * 25_000


def test_a_batch_rewrites_only_its_buckets_and_two_versions_stay(spark, tmp_path):
    schema = spark.createDataFrame([], "user_id long, last_activity int, v string").schema
    table = BucketTable(str(tmp_path), "user_id", schema, lambda df: df, lambda old, new: C.upsert_latest(old, new, "user_id"))
    table(spark.createDataFrame([(i, 1, "a") for i in range(500)], schema), 0)
    buckets = lambda version: [p.name for p in (tmp_path / "data" / f"version={version}").iterdir() if "=" in p.name]
    assert len(buckets(0)) == 64
    for version in (1, 2, 2):
        table(spark.createDataFrame([(7, version + 1, f"b{version}")], schema), version)
        assert len(buckets(version)) == 1 and buckets(version) == buckets(1)
    rows = {r.user_id: r.v for r in table.read(spark).collect()}
    assert len(rows) == 500 and rows.pop(7) == "b2" and set(rows.values()) == {"a"}
    assert {r.user_id: r.v for r in table.read(spark, previous=True).collect()}[7] == "b1"
    assert buckets(1)[0] not in buckets(0) and len(buckets(0)) == 63  # the version before the previous one is gone
    table(spark.createDataFrame([], schema), 3)
    assert table.read(spark).count() == 500


def test_progress_of_150_batches_is_reported(spark, tmp_path):
    folder = str(tmp_path)
    records = spark.range(450).select(F.col("id").cast("string").alias("key"), F.lit("{}").alias("value"))
    records.repartition(150).write.json(f"{folder}/topic")
    with sinks.logged(spark, f"{folder}/progress") as log:
        stream = sources.file_records(spark, f"{folder}/topic", max_files=1)
        query = sinks.run_available(stream, lambda df, batch: df.write.format("noop").mode("append").save(), f"{folder}/checkpoint")
        rows = log.of(query).where("input_rows > 0").collect()
    assert len(rows) == len({r.batch for r in rows}) == 150 and sum(r.input_rows for r in rows) == 450


def test_an_alert_that_later_samples_lift_is_not_raised(spark, tmp_path):
    """Window 0 starts with one error and one request, far above 5 %, and ends with 100 requests."""
    sample = "ts timestamp, metric_name string"
    at_ = lambda minutes, name: (BASE + dt.timedelta(minutes=minutes), name)
    parts = [[at_(1, "error"), at_(2, "latency_ms")], [at_(3 + i / 4, "latency_ms") for i in range(100)] + [at_(70, "error"), at_(71, "latency_ms")], [at_(600, "latency_ms")]]
    folder, seen = str(tmp_path), []
    schema = spark.createDataFrame([], sample).schema
    spark.createDataFrame(parts[0], schema).coalesce(1).write.parquet(f"{folder}/in/part=0")
    rates = M.error_rates(S.watermarked(sources.parquet_events(spark, f"{folder}/in", schema)).withColumn("w", F.window("ts", "60 minutes")), ["w"])

    def callback(df, batch):
        values = df.select(F.col("w.start").alias("window_start"), F.lit("error_rate").alias("metric_name"), F.col("error_rate").alias("value"))
        seen.extend((r.ts, r.severity) for r in M.alerts(values).collect())

    for number, rows in enumerate(parts):
        if number:
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/part={number}")
        sinks.run_available(rates, callback, f"{folder}/checkpoint")
    assert seen == [(BASE + dt.timedelta(minutes=60), "critical")]


def test_zero_dwell_is_absent_and_bands(spark):
    row = C.enrich(spark.createDataFrame([event(1, dwell=0.0, scroll=75.0)], EVENTS)).first()
    assert row.dwell_time_seconds is None and row.dwell_time_category is None and row.scroll_depth_category == "very_high"


def test_scores_are_capped(spark):
    row = C.event_scores(spark.createDataFrame([event(1, kind="purchase", dwell=9000.0, scroll=100.0)], EVENTS)).first()
    assert abs(row.engagement_score - 1.0) < 1e-12 and row.popularity_score == 1.0


def test_malformed_record_goes_to_the_corrupt_column(spark):
    good = '{"event_id": 5, "user_id": 7}'
    records = spark.createDataFrame([("a", good), ("b", "{broken")], "key string, value string")
    schema = spark.createDataFrame([], "event_id long, user_id long").schema
    got = {r.key: r for r in sources.decode(records, schema).collect()}
    assert got["a"].event_id == 5 and got["a"][sources.CORRUPT] is None
    assert got["b"].event_id is None and got["b"][sources.CORRUPT] == "{broken"


def feature_rows(spark):
    rows = [("user", 1, 0, 60, 1.0), ("user", 1, 10, 70, 2.0), ("user", 2, 0, 30, 3.0), ("user", 3, 40, 100, 4.0)]
    df = spark.createDataFrame(rows, "entity_type string, entity_id long, a int, b int, v double")
    moment = lambda c: F.lit(BASE.isoformat(sep=" ")).cast("timestamp") + F.make_dt_interval(mins=F.col(c))
    return df.select("entity_type", "entity_id", F.create_map(F.lit("v"), "v").alias("features"), moment("a").alias("stored_at"), moment("b").alias("expires_at"), F.lit("v1").alias("version"))


def test_live_rows(spark):
    ids = spark.createDataFrame([("user", i) for i in (1, 2, 3, 4)], "entity_type string, entity_id long")
    got = {r.entity_id: r.features for r in T.lookup_ids(feature_rows(spark), ids, at(30)).collect()}
    assert got == {1: {"v": 2.0}, 2: None, 3: None, 4: None}  # 2 expires exactly now, 3 is not stored yet


def test_patch_keeps_expiry_and_skips_the_dead(spark):
    patches = spark.createDataFrame([("user", 1, {"v": 9.0, "w": 1.0}), ("user", 2, {"w": 1.0})], "entity_type string, entity_id long, changes map<string,double>")
    got = T.patch(feature_rows(spark), patches, at(30)).collect()
    assert [(r.entity_id, r.features) for r in got] == [(1, {"v": 9.0, "w": 1.0})]


def test_as_of_lookup_before_the_first_row_is_null(spark):
    facts = spark.createDataFrame([event(1, minutes=5), event(2, minutes=10), event(3, minutes=99), event(4, user=8)], EVENTS)
    feats = spark.createDataFrame([event(10, minutes=10, dwell=1.0), event(11, minutes=20, dwell=2.0)], EVENTS)
    got = {r.event_id: r.dwell_time_as_of for r in T.as_of_features(facts, feats, "user_id", "ts", "ts", "dwell_time", "event_id").collect()}
    assert got == {1: None, 2: 1.0, 3: 2.0, 4: None}


def test_percentiles_need_more_than_ten_values(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", float(i)) for i in range(11)], "k string, v double")
    assert sorted((r.k, r.p95) for r in O.nearest_percentiles(df, "v", ["k"]).collect()) == [("a", None), ("b", 10.0)]


def test_single_value_has_no_deviation_and_errors_without_requests(spark):
    rows = [(BASE, "latency_ms", 5.0), (BASE, "error", 1.0), (BASE, "error", 1.0)]
    df = spark.createDataFrame(rows, "ts timestamp, metric_name string, metric_value double")
    assert M.summary(df.where("metric_name = 'latency_ms'"), ["metric_name"]).first()["std"] == 0.0
    assert M.error_rates(df.where("metric_name = 'error'"), []).first().error_rate == 200.0


def test_alert_thresholds_are_strict_and_critical_replaces_warning(spark):
    values = [("latency_p95", 200.0), ("latency_p95", 200.1), ("latency_p95", 300.0), ("latency_p95", 300.5), ("error_rate", 5.0), ("error_rate", 6.0), ("ctr_drop", 10.0), ("ctr_drop", 20.1)]
    df = spark.createDataFrame([(BASE + dt.timedelta(minutes=i), m, v) for i, (m, v) in enumerate(values)], "window_start timestamp, metric_name string, value double")
    got = M.alerts(df).orderBy("ts").collect()
    assert [(r.current_value, r.severity) for r in got] == [(200.1, "warning"), (300.0, "warning"), (300.5, "critical"), (5.0, "warning"), (6.0, "critical"), (20.1, "critical")]
    assert got[2].message == "latency_p95 300.5ms exceeds the critical threshold of 300.0ms"


def test_admission_equals_a_plain_loop(spark):
    random.seed(1)
    moments, t = [], 0
    for _ in range(200):
        t += random.choice([0, 60, 300, 600, 900, 4000])
        moments.append(t)
    rows = [(f"a{i:04d}", BASE + dt.timedelta(seconds=s), "error_rate", "critical") for i, s in enumerate(moments)]
    admitted, expected = [], {}
    for (name, *_), s in zip(rows, moments):
        if admitted and s - admitted[-1] < 600:
            expected[name] = "cooldown"
        elif sum(a >= s - 3600 for a in admitted) >= 3:
            expected[name] = "hourly_limit"
        else:
            admitted.append(s)
            expected[name] = "admitted"
    df = spark.createDataFrame([*rows, ("w", BASE, "error_rate", "warning")], "alert_id string, ts timestamp, metric_name string, severity string")
    assert {r.alert_id: r.decision for r in M.admit(df).collect()} == expected


def test_drift_of_a_sample_with_itself_is_zero_and_of_a_shifted_one_is_not(spark):
    same = spark.range(500).select((F.col("id") % 97).cast("double").alias("x"))
    moved = same.select((F.col("x") + 60).alias("x"))
    assert P.stability_index(same, same, ["x"]).first().psi == 0.0
    assert P.largest_gap(same, same, ["x"]).first().ks == 0.0
    assert P.stability_index(same, moved, ["x"]).first().psi > 0.25
    assert 0.5 < P.largest_gap(same, moved, ["x"]).first().ks <= 1.0
    assert P.drift_alerts(P.stability_index(same, moved, ["x"]), P.largest_gap(same, moved, ["x"])).first().severity == "critical"
