"""Benchmark: headline checks at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs once to warm up, then three times; the median is reported.  A run
executes the whole plan through the ``noop`` sink (no collect to the driver).
Prints ONE JSON line on stdout.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "auc_binary", "binary_metrics", "roc_curve", "average_precision", "auc_ovr", "regression_metrics",
    "numeric_summary", "spearman_target", "psi_by_feature", "distribution_distances",
    "conformal_pvalues", "calibration_curve", "worst_samples", "resilience_sweep_clf",
    "fairness_ratios", "permutation_importance", "noise_sensitivity", "robustness_runs",
    "pdp_two_way", "linear_shap", "time_slice_drift",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from probity.registry import queries
    from probity.session import get_session
    spark = get_session(f"local[{cpus}]", app="probity-bench", shuffle_partitions=max(8, 2 * cpus),
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
                               "spark.sql.files.maxPartitionBytes": str(32 * 1024 * 1024)})
    qs = queries()
    names = only or HEADLINE
    out = {}
    for name in names:
        fn = qs[name]
        times = []
        for i in range(repeats + 1):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i > 0:
                times.append(dt)
        out[name] = round(statistics.median(times), 3)
        print(f"{name}: {out[name]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    print(json.dumps({"metric": "headline_total_median_sec", "value": round(sum(out.values()), 3), "unit": "sec",
                      "queries": out, "sf": sf, "cpus": cpus, "repeats": repeats}))
    spark.stop()


if __name__ == "__main__":
    main()
