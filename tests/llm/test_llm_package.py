"""Workers find the operators, whatever folder the driver is in."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]

DRIVER = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {work!r}).getOrCreate()
print("ROWS", entry.queries()[{name!r}](spark, {data!r}).count())
"""


@pytest.mark.parametrize("name", ["op7_bucket_refinement", "op12_apportioned_mix"])
def test_a_driver_in_another_folder(tmp_path, small_dir, name):
    code = DRIVER.format(root=str(ROOT), work=str(tmp_path / "work"), name=name, data=small_dir)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS" in done.stdout, done.stderr[-2000:]
