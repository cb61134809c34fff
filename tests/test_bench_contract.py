"""bench.py prints exactly one JSON line with the fields the driver records."""
import json
import os
import subprocess
import sys

from paths import ROOT, SF_SMALL


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF_SMALL, BENCH_RUNS="1", BENCH_CPUS="4")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env,
                         capture_output=True, text=True, timeout=900, check=True).stdout
    lines = [l for l in out.splitlines() if l.strip()]
    assert len(lines) == 1
    rec = json.loads(lines[0])
    assert rec["unit"] == "sec" and rec["metric"] and rec["sf"] == "0.001"
    assert rec["value"] > 0 and {"catalog_build", "train_model", "score_catalog"} <= set(rec["queries"])
    assert abs(sum(rec["queries"].values()) - rec["value"]) < 0.01
