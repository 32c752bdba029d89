"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shoplens.plans import all_queries  # noqa: E402
from shoplens.session import build_session  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "b_clean_interactions", "c6_expectation_suites", "d2_facts_with_dimensions", "d_interaction_features", "e1_user_profile", "e16_rollups", "e_user_features", "e_product_features", "f1_label_encoding",
    "g2_top_partners", "g5_ordered_split", "j5_lift", "j9_basket_recommendation_jaccard", "j10_shared_buyers", "k1_most_similar",
    "k3_hybrid_scores", "l2_rating_matrix", "l6_als_factors", "l6_als_rank50", "m9_pair_features", "m11_negative_samples", "n1_train_ranker", "o1_personal_top", "o8_cold_start",
    "p5_sessions", "p13_running_means", "q7_point_in_time", "r1_numeric_profile", "s1_window_summary", "s9_rollback_admission",
]


def main() -> None:
    spark = build_session(f"local[{CPUS}]", int(CPUS))
    queries, times = all_queries(), {}
    names = sys.argv[1:] or HEADLINE
    queries["e7_value_counts"](spark, FOLDER).write.format("noop").mode("overwrite").save()  # warm the session
    for name in names:
        start = time.perf_counter()
        queries[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(FOLDER.rstrip("/"))})
    )
    spark.stop()


if __name__ == "__main__":
    main()
