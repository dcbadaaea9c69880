"""Summarise the physical plans of the headline queries (PLANS.md).

For each query: scans with their pruned columns and pushed filters, shuffle
exchanges, broadcasts, windows, and whole-stage-codegen stages of the
executed (AQE-final) plan. Usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""

import re
import sys

sys.path.insert(0, ".")
from bench import HEADLINE  # noqa: E402
from tessera.registry import load_all  # noqa: E402
from tessera.session import get_spark  # noqa: E402


CODEGEN = r"\*\((\d+)\)"
EXPR_ID = r"#\d+L?"


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("plans", cpus=8, shuffle_partitions=16)
    spark.conf.set("spark.sql.maxMetadataStringLength", "400")
    reg = load_all()
    print("# Physical plans of the headline queries\n")
    print(f"Generated by `tools/plan_report.py` on `{sf}` (local[8], AQE on). Counts are over the final")
    print("adaptive plan after execution; `ReadSchema` shows column pruning, `PushedFilters` predicate pushdown.\n")
    for name in HEADLINE:
        df = reg[name].run(spark, sf)
        df.collect()  # runs this very plan, so AQE finalises it in place
        qe = df._jdf.queryExecution()
        plan = qe.executedPlan().toString().split("== Initial Plan ==")[0]  # final adaptive plan only
        lines = plan.splitlines()
        scans = [l.strip() for l in lines if "FileScan" in l or "Scan ExistingRDD" in l or "Range (" in l]
        print(f"## `{name}`\n")
        print(f"* shuffle exchanges: {sum('Exchange hashpartitioning' in l or 'Exchange rangepartitioning' in l or 'Exchange RoundRobin' in l for l in lines)}, "
              f"single-partition exchanges (global aggregates of small results): {sum('Exchange SinglePartition' in l for l in lines)}, "
              f"broadcasts: {sum('BroadcastExchange' in l for l in lines)}, windows: {sum(l.strip().startswith(('+- Window', 'Window', ':- Window')) or ' Window [' in l for l in lines)}, "
              f"codegen stages: {len(set(re.findall(CODEGEN, plan)))}")
        for s in scans:
            cols = re.search(r"\[(.*?)\] Batched", s)
            pushed = re.search(r"PushedFilters: \[(.*?)\]", s)
            table = re.search(r"/([a-z_]+)\.parquet", s)
            if cols:
                print(f"* scan `{table.group(1) if table else '?'}`: columns `{re.sub(EXPR_ID, '', cols.group(1))}`"
                      + (f"; pushed `{pushed.group(1)}`" if pushed and pushed.group(1) else ""))
            else:
                print(f"* {s[:120]}")
        print()
    spark.stop()


if __name__ == "__main__":
    main()
