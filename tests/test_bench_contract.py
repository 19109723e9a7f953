"""bench.py prints exactly one JSON line with the fields the driver reads."""

import json
import os
import subprocess
import sys


def test_bench_prints_one_json_line():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2", BENCH_REPEAT="1",
               BENCH_SMOKE_DIR="/nonexistent")
    out = subprocess.run([sys.executable, os.path.join(root, "bench.py")], capture_output=True, text=True, env=env,
                         timeout=900, check=True).stdout
    lines = [line for line in out.splitlines() if line.strip()]
    assert len(lines) == 1
    d = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(d)
    assert d["unit"] == "sec" and d["sf"] == 0.001 and len(d["queries"]) == 17
    assert abs(d["value"] - sum(d["queries"].values())) < 0.01
