"""Benchmark the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints ONE JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is fully executed with the ``noop`` sink (the whole plan runs,
nothing is collected to the driver).  The same queries first run once,
untimed, on the sf0.001 tables (``$BENCH_WARMUP_DIR``) so JVM start-up and
JIT warm-up are not charged to the first timed queries.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.plans import QUERIES  # noqa: E402
from tessera.session import local_session  # noqa: E402

HEADLINE = [
    "profile_orders", "profile_all_tables", "detect_keys_orders_customer", "merge_chain",
    "merge_size", "histogram_price", "kde_quantity", "corr_matrix", "box_by_flag", "quality_flags",
    "impute_plan", "impute_ffill", "scale_robust", "anova", "chi2", "auc", "pr_threshold",
    "runs_ranked", "lineage_closure", "stream_state",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=max(4, int(cpus) * 2) if cpus.isdigit() else 8,
                          app="tessera-bench")
    # Untimed warm-up on the smallest tables: JIT and code-generation caches
    # are filled once, so the timings below are steady-state query times.
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if warm and os.path.isdir(warm):
        for name in names:
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
