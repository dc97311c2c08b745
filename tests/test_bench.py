"""The benchmark script prints one JSON line of times."""

import json
import os
import subprocess
import sys

from conftest import ROOT


def test_bench_prints_times():
    settings = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2",
                    BENCH_QUERIES="kpis payment_breakdown")
    run = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=settings,
                         capture_output=True, text=True, timeout=300, check=True)
    line = json.loads(run.stdout.strip().splitlines()[-1])
    assert set(line["queries"]) == {"kpis", "payment_breakdown"}
    assert line["value"] > 0 and line["sf"] == "0.001"
