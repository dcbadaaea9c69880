"""Benchmark the headline queries at one scale factor.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (timed runs per query, default 3; one untimed warm-up first).
Each run executes the full plan and discards the rows with the ``noop``
sink, so the time covers scan, shuffle and compute but not collection.
Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.registry import load_all  # noqa: E402
from tessera.session import get_spark  # noqa: E402

HEADLINE = [
    "q2_profile_gappy",                 # Q2 profile all columns
    "m8_outliers_iqr_gappy",            # M8 outlier bounds
    "m10_remove_outliers_iqr_gappy",    # M10 removal
    "a1_corr_matrix_chem",              # A1 correlation matrix
    "g6_group_sums_chem",               # G6 group sums
    "g14_pair_winners_chem",            # G14 winner pairs
    "h8_half_life_decay",               # H2+H8 per-row fit and half-life
    "p13_performance_index",            # P13 performance-index pipeline
    "v5_auc_lineitem",                  # V5 binary AUC on a lineitem-sized table
    "d_design_search",                  # D1+D4+D7 design search
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    extra = {}
    if os.environ.get("BENCH_EXTRA"):  # e.g. "k=v,k2=v2" for config experiments
        extra = dict(kv.split("=", 1) for kv in os.environ["BENCH_EXTRA"].split(","))
    spark = get_spark("bench", cpus=cpus, shuffle_partitions=max(int(cpus) * 2, 8), extra=extra)
    reg = load_all()
    out = {}
    for name in HEADLINE:
        if name not in reg:
            continue
        q = reg[name]
        q.run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        times = []
        for _ in range(runs):
            t0 = time.perf_counter()
            q.run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t0)
        out[name] = round(statistics.median(times), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_median_sec", "value": round(sum(out.values()), 3), "unit": "sec",
                      "queries": out, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus), "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
