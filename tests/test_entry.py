"""The entry module from a process whose workers don't find the package by themselves."""

import os
import subprocess
import sys

from tests.conftest import ROOT

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert set(e.oracle_sql()) <= set(e.queries())
print("ROWS", e.queries()["exact_knn_l2"](spark, {data!r}).count())
"""


def test_package_reaches_the_workers(sf_dir, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(ROOT), data=sf_dir)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "ROWS 500" in run.stdout, run.stderr[-2000:]
