"""Where intermediate tables go: the context's folder, the configured one, or a clear error."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
import sys
from pyspark.sql import SparkSession
from stockline.session import ensure_checkpoint_dir, scratch_path
builder = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
if sys.argv[1] == "configured":
    builder = builder.config("spark.checkpoint.dir", sys.argv[2])
spark = builder.getOrCreate()
if sys.argv[1] == "context":
    spark.sparkContext.setCheckpointDir(sys.argv[2])
try:
    path = scratch_path(spark, "x")
    spark.range(3).write.parquet(path)
    print("GOT", path, spark.read.parquet(path).count())
except RuntimeError as e:
    print("ERROR", e)
"""


@pytest.mark.parametrize("how", ["neither", "configured", "context"])
def test_checkpoint_folder(tmp_path, how):
    conf = tmp_path / "conf"  # a folder without Spark defaults
    conf.mkdir()
    env = os.environ | {"SPARK_CONF_DIR": str(conf), "PYTHONPATH": str(ROOT)}
    run = subprocess.run([sys.executable, "-c", SCRIPT, how, str(tmp_path / "shared")], env=env, cwd=ROOT, capture_output=True, text=True, timeout=120)
    last = run.stdout.strip().splitlines()[-1]
    if how == "neither":
        assert last.startswith("ERROR no shared folder") and "spark.checkpoint.dir" in last
    else:
        assert last.startswith("GOT") and "shared" in last and last.endswith(" 3")
