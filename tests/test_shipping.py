"""Functions run in workers that cannot import the package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from gitquarry.session import build_session
from gitquarry.plans.registry import QUERIES
spark = build_session(master="local[2]", shuffle_partitions=2, driver_memory="2g")
print("ROWS", len(QUERIES["pair_features_rules"](spark, "/root/testdata/sf0.001").collect()))
"""


def test_udfs_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
    assert int(out.stdout.split("ROWS")[1]) > 0
