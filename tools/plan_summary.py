"""Summarise the static physical plan (AQE off) of each report: source
scans, shuffles, reused shuffles, join strategies, Expand / Window nodes."""

from __future__ import annotations

import collections
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from subscope.plans.registry import builders  # noqa: E402
from subscope.session import build_session  # noqa: E402
from subscope.sources.fixtures import fixture_tables  # noqa: E402

NODES = ["Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition", "ReusedExchange",
         "BroadcastExchange", "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin",
         "Expand", "Window", "Generate"]


def summarise(plan: str) -> tuple[dict, dict]:
    scans = collections.Counter(
        re.findall(r"FileScan parquet .*?Location: InMemoryFileIndex\(\d+ paths\)\[file:[^\]]*/(\w+?)(?:\.parquet)?[,\]]", plan)
    )
    return dict(scans), {n: plan.count(n) for n in NODES if plan.count(n)}


def main():
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.1")
    spark = build_session()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    if "--large" in sys.argv:  # what a large cluster plans: no broadcast by size
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    if os.environ.get("STORED_DIR"):
        # the tables as stored by write_tables (CRM partitioned by snapshot date)
        from subscope.sources.tables import read_tables, write_tables

        root = os.environ["STORED_DIR"]
        if not os.path.exists(f"{root}/crm_snapshots"):
            write_tables(fixture_tables(spark, sf), root)
        t = read_tables(spark, root)
    else:
        t = fixture_tables(spark, sf)
    b = builders()
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    keys = args or list(b)
    if "--markdown" in sys.argv:
        cols = ["CRM scans", "orders scans", "other scans", "hash shuffles", "reused shuffles", "broadcasts",
                "sort-merge joins", "broadcast hash joins", "nested-loop joins", "windows"]
        print("| key | " + " | ".join(cols) + " |")
        print("| --- |" + " --- |" * len(cols))
    folder = os.environ.get("FORMATTED_DIR")  # one explain("formatted") file for each key
    for k in keys:
        if folder:
            with open(f"{folder}/{k}.txt", "w") as f:
                text = b[k](t)._jdf.queryExecution().explainString(
                    spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
                f.write(re.sub(r"file:/[^\]\s,]*/(?=\w+[\],])", "", text))
        scans, counts = summarise(b[k](t)._jdf.queryExecution().executedPlan().toString())
        if "--markdown" in sys.argv:
            other = sum(v for k2, v in scans.items() if k2 not in ("crm_snapshots", "service_orders"))
            vals = [scans.get("crm_snapshots", 0), scans.get("service_orders", 0), other,
                    counts.get("Exchange hashpartitioning", 0),
                    counts.get("ReusedExchange", 0), counts.get("BroadcastExchange", 0),
                    counts.get("SortMergeJoin", 0), counts.get("BroadcastHashJoin", 0),
                    counts.get("BroadcastNestedLoopJoin", 0), counts.get("Window", 0)]
            print(f"| `{k}` | " + " | ".join(str(v) for v in vals) + " |")
        else:
            print(f"{k}: scans={scans} {counts}")


if __name__ == "__main__":
    main()
