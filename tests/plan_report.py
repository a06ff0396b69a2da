"""Summarise the executed (AQE final) physical plan of every registered query.

Usage: python tests/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def summarise(plan: str) -> dict:
    lines = plan.split("\n")
    out = {
        "shuffles": sum(1 for ln in lines if re.search(r"\bExchange hashpartitioning|\bExchange SinglePartition|"
                                                        r"\bExchange rangepartitioning", ln)),
        "broadcasts": sum(1 for ln in lines if "BroadcastExchange" in ln),
        "joins": [re.search(r"(\w+Join) \[?.*?(Inner|LeftOuter|RightOuter|FullOuter|LeftSemi|LeftAnti)", ln).group(1, 2)
                  for ln in lines if re.search(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin)", ln)
                  and re.search(r"(Inner|LeftOuter|RightOuter|FullOuter|LeftSemi|LeftAnti)", ln)],
        "windows": [re.sub(r"#\d+L?| NULLS FIRST| NULLS LAST", "", m)
                    for m in re.findall(r"windowspecdefinition\((.*?), specifiedwindowframe", plan)],
        "scans": [],
    }
    for m in re.finditer(r"FileScan (\w+) \[([^\]]*)\].*?PushedFilters: \[([^\]]*)\]", plan):
        cols = [re.sub(r"#\d+L?", "", c) for c in m.group(2).split(",")]
        out["scans"].append((m.group(1), len(cols), m.group(3)[:80]))
    return out


def main():
    from tally.session import build_session
    from tally.plans.catalog import QUERIES
    from tally.session import release_scratch
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=8)
    print(f"# Physical plans (AQE final plans at {os.path.basename(sf)})\n")
    print("Generated by `python tests/plan_report.py`. Per query: number of shuffles and broadcasts, joins "
          "(strategy, type), window partition/order keys over row data, and scans (format, columns read, "
          "pushed filters).\n")
    print("Reading notes: each driver table is one parquet row group, so scans are single tasks here. Windows "
          "keyed by `file_key, blk` run over ledger rows and are bounded by one ordinal block. Windows keyed by "
          "`account_id, file_key` run over aggregated month rows (at most one per calendar month per file). "
          "Broadcasts are chosen by Spark from measured sizes, and per-block tables cut by "
          "`checkpoint()` appear as scans of checkpointed data.\n")
    for name, q in QUERIES.items():
        df = q(spark, sf)
        df.write.format("noop").mode("overwrite").save()
        s = summarise(df._jdf.queryExecution().executedPlan().toString())
        print(f"## {name}\n")
        print(f"- shuffles: {s['shuffles']}, broadcasts: {s['broadcasts']}")
        if s["joins"]:
            print("- joins: " + ", ".join(f"{a} {b}" for a, b in s["joins"]))
        if s["windows"]:
            print("- windows: " + "; ".join(sorted(set(s["windows"]))))
        for fmt, n, pushed in s["scans"]:
            print(f"- scan {fmt}: {n} columns read; pushed filters: [{pushed}]")
        print()
        release_scratch(spark)


if __name__ == "__main__":
    main()
