"""Benchmark: the sixteen reports at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (sum of per-report seconds), "unit",
"queries" {key: sec}, "sf"}. Every report runs once at sf0.001 first (JVM and
code warm, as in the baseline session), then $BENCH_REPEAT (default 3) times;
its time is the median. A run writes the whole result to Spark's no-op sink,
so no rows pass through the driver; it includes deriving the canonical tables
from the parquet files, like the baseline.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from subscope.plans.registry import queries  # noqa: E402
from subscope.plans.reports import REPORTS  # noqa: E402
from subscope.session import build_session  # noqa: E402


def seconds(df) -> float:
    t0 = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(cpus, 8), app="subscope-bench")
    qs = queries()
    smoke = os.environ.get("BENCH_SMOKE_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(smoke):
        for key in REPORTS:
            seconds(qs[key](spark, smoke))
    times = {}
    for key in REPORTS:
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            df = qs[key](spark, sf_dir)  # planning counts
            runs.append(time.perf_counter() - t0 + seconds(df))
        times[key] = round(median(runs), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "reports_total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
