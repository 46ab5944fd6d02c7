import json
import os
import subprocess
import sys
from pathlib import Path


def test_bench_prints_one_json_line():
    env = os.environ | {"BENCH_SF_DIR": "/root/testdata/sf0.001", "BENCH_CPUS": "2", "BENCH_QUERIES": "graph_nodes,duplicate_keys"}
    done = subprocess.run([sys.executable, str(Path(__file__).resolve().parent.parent / "bench.py")], env=env, capture_output=True, text=True, timeout=300, check=True)
    lines = done.stdout.strip().splitlines()
    assert len(lines) == 1
    found = json.loads(lines[0])
    assert found["unit"] == "sec" and set(found["queries"]) == {"graph_nodes", "duplicate_keys"} and found["sf"] == 0.001
