"""Registered queries against their SQL in DuckDB. SHOPLENS_ALL=1 runs every one, otherwise one or more per area."""

import os

import pytest

from check import connect, oracle_rows, table
from shoplens.plans import all_oracles, all_queries

SAMPLE = (
    "a1_parquet_scan a4_csv_sink a10_topic_routing b8_domain_filters b_clean_users c6_expectation_suites c12_references d2_facts_with_dimensions d7_index_join "
    "d10_pairs_in_session e1_user_profile e4_user_rates e12_distributions e16_rollups f1_label_encoding f9_hash_code g1_recent_rows g2_top_partners "
    "g5_ordered_split g10_nearest_percentiles h2_list_changes j4_jaccard j5_lift j10_shared_buyers k1_cosine_rows k3_hybrid_scores "
    "l2_rating_matrix l7_bias_terms l11_training_summary m1_user_block m2_item_block m9_pair_features n8_list_comparison o1_personal_top o4_user_history "
    "o9_experiment p1_enrichment p2_stream_user_totals p5_sessions p5_stream_sessions p12_stream_upsert p13_running_means p16_late_data p17_deduplication "
    "q2_live_lookup q6_online_user_features q7_point_in_time r1_numeric_profile r3_quality_checks r6_stability_index s1_window_summary s4_alerts "
    "s9_rollback_admission t2_alert_callback"
).split()
NAMES = sorted(all_oracles()) if os.environ.get("SHOPLENS_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, small, name):
    df = all_queries()[name](spark, small)
    mine = table(df.columns, [tuple(r) for r in df.collect()])
    assert mine == table(*oracle_rows(con, all_oracles()[name]))


def test_names_and_coverage():
    names, oracles = set(all_queries()), set(all_oracles())
    assert oracles <= names and len(names) >= 215
    assert names == oracles
