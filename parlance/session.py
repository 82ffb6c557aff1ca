"""Session helpers.

The cluster names a shared folder in ``spark.checkpoint.dir``; lineage cuts,
saved models and streaming checkpoints live there.  We only set our own
folder when the session has none (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "parlance", max_partition_bytes: str = "64m",
                scan_partitions: int | None = None, driver_memory: str | None = None) -> SparkSession:
    """Session for the jobs.

    ``shuffle_partitions`` is the starting point AQE coalesces from; size it
    to the cluster (e.g. 2-3x the task slots at 100 TB).  Text featurisation
    is CPU-heavy per byte, so scan splits are smaller than the 128 MB default
    (``max_partition_bytes``), spreading a large text scan over more tasks.
    ``scan_partitions`` deals scanned rows over so many partitions: for inputs
    of one row group, which cannot be split; leave it unset on real tables.
    ``driver_memory`` is for a local master, where the driver does all the
    work; otherwise the cluster's setting holds.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", max_partition_bytes)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    if scan_partitions:
        builder = builder.config("spark.parlance.scanPartitions", str(scan_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints / written tables.

    Read from the session (``spark.checkpoint.dir``); only a local master
    (local runs, tests) may leave it unset, then a fresh folder is created and
    registered.
    """
    d = spark.conf.get(_CKPT_KEY, None)
    if not d:
        d = spark.sparkContext.getConf().get(_CKPT_KEY, None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_CKPT_KEY} to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="parlance-ckpt-", dir="/tmp")
        spark.conf.set(_CKPT_KEY, d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, *parts: str, unique: bool = True) -> str:
    """A path inside the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    if unique:
        parts = parts + (uuid.uuid4().hex[:12],)
    return os.path.join(base, *parts)
