"""The package on workers that can't import it."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
import roadlark
from roadlark.operators import rules
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
roadlark.ship(spark)
df = spark.createDataFrame([(1, 0, 4.0, 2.0), (1, 1, 0.0, 2.0)], "k long, d int, points double, e double")
print("ROWS", rules.replay(df, "k", "d", "points", "e").count())
spark.stop()
"""


def test_workers_get_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", CODE, str(ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "ROWS 2" in run.stdout, run.stderr[-2000:]
