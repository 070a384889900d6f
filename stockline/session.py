"""Spark session and scratch-location helpers.

Library code never sets cluster-wide configuration on an existing session; it
only reads settings.  ``local_session`` is for tests, the bench and the
examples, where no cluster manager has configured anything.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "stockline") -> SparkSession:
    """Local session for tests and benchmarks (UI off, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("STOCKLINE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    context = spark.sparkContext
    context.setLogLevel("ERROR")
    # One process, one disk: a local folder is shared here, and only here.
    if context.getCheckpointDir() is None and not context.getConf().get("spark.checkpoint.dir"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="stockline-ckpt-"))
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    A folder already set on the context (``setCheckpointDir``) wins; otherwise
    ``spark.checkpoint.dir`` names it.  No folder is invented: a machine-local
    one would be invisible to other executors, so with neither set this raises.
    """
    current = spark.sparkContext.getCheckpointDir()
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        if current is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current is None:
        raise RuntimeError(
            "no shared folder for intermediate tables: start Spark with spark.checkpoint.dir, "
            "or call SparkContext.setCheckpointDir with a path that all executors can reach"
        )
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder for a written table."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"
