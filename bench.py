"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and
print one JSON line.

Each query is materialised in full with the ``noop`` sink (every row is
computed, nothing is collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "p_model_ready",                      # entry A: clean + lookups + history window
    "w1_w3_career_to_date",
    "f1_e6_flagship_holdout_metrics",     # flagship
    "f2_oof_target_encoding",
    "e6_metrics_by_model",                # exact AUC / AP / ECE / Brier per model
    "e8_class_profile",
    "c1_c2_isotonic_by_range",
    "n3_weighted_search_top20",           # 53,130-tuple grid via the Gram form
    "n1_equal_weight_top10",
    "m1_logreg_holdout",
    "m7_gam_holdout",
]


#: With BENCH_FULL=1 also the models at their full sizes; minutes each.
FULL = ["m3_bootstrap_logreg_holdout", "m4_bagged_trees_holdout", "m5_boosted_trees_holdout", "m6_monotone_distance_audit",
        "v2_c6_bagging_oof_calibrated_holdout", "x2_x5_effect_summary", "x4_effects_by_segment", "n7_stacked_meta_search",
        "b1_scenario_batch_scoring", "n8_base_models_to_ensembles"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from probengine.plans import catalog
    from probengine.session import get_spark

    spark = get_spark(app="probengine-bench", cpus=cpus)
    qs = catalog.spark_queries()
    # warm-up, not timed: the same plans once on the smallest tables, so JIT
    # compilation and Python worker start-up are not charged to the first query
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    for name in HEADLINE:
        qs[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE + (FULL if os.environ.get("BENCH_FULL") == "1" else []):
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
