"""Run queries where the executors' Python has no copy of the library on its path."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("ROWS", *[len(entry.queries()[n](spark, sys.argv[2]).collect()) for n in sys.argv[3:]])
"""


def rows(sf_dir, folder, *names):
    """The number of rows of each query."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE, ROOT, sf_dir, *names], cwd=folder, env=env, capture_output=True, text=True)
    assert "ROWS" in done.stdout, done.stderr[-2000:]
    return [int(n) for n in done.stdout.rpartition("ROWS")[2].split()]
