import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

PROGRAM = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession, functions as F
from twinloom.operators.nearest import nearest_distance
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
points = spark.range(50).select(F.array(F.col("id") * 2.0).alias("x"))
asked = spark.range(40).select(F.array(F.col("id") + 0.25).alias("x"))
for how in ({{}}, {{"broadcast_points": 5}}):
    far = nearest_distance(asked, points, **how).agg(F.sum("n"), F.sum("dist")).first()
    assert tuple(far) == (40, 20 * 0.25 + 20 * 0.75), far
print("fine")
"""


def test_workers_need_no_installed_package(tmp_path):
    """Run from a folder where the package cannot be imported by the workers."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", PROGRAM], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "fine" in done.stdout, done.stderr[-2000:]
