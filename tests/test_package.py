"""The package reaches the workers of a driver that runs anywhere."""

import os
import subprocess
import sys

from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

DRIVER = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {work!r}).getOrCreate()
print("ROWS", entry.queries()[{name!r}](spark, {data!r}).count())
"""


def run_elsewhere(name, folder, data):
    """Run a query from a driver in another folder, which knows the path of the entry file only."""
    code = DRIVER.format(root=str(ROOT), work=str(folder / "work"), name=name, data=data)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=600)


def test_a_driver_in_another_folder(tmp_path, sf_dir):
    done = run_elsewhere("user_model_arms", tmp_path, sf_dir)
    assert "ROWS" in done.stdout, done.stderr[-2000:]
