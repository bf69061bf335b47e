"""Workers import the package though it is neither installed nor in their folder."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
JOB = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pulseweave.session import build_session
from pulseweave.operators.clustering import leader_clusters
from pulseweave.lineage import drop_scratch, shared_dir
spark = build_session("away", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
rows = spark.createDataFrame([("g", i, [1.0, float(i % 2)]) for i in range(6)], "g string, i long, v array<double>")
print("leaders", sorted({{r.leader for r in leader_clusters(rows, ["g"], "i", "i", "v", 0.9).collect()}}))
print("scratch", shared_dir(spark))
drop_scratch(spark)
"""


def test_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", JOB], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "leaders [0, 1]" in out.stdout, out.stderr[-2000:]
    scratch = next(line.split(maxsplit=1)[1] for line in out.stdout.splitlines() if line.startswith("scratch"))
    assert not os.path.exists(scratch.removeprefix("file:"))
