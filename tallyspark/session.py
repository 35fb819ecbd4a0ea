"""Session helpers.

The engine needs two settings pinned on every session it runs in:

* ``spark.sql.session.timeZone=UTC`` -- ISO-8601 rendering (X1) prints UTC with a ``Z``.
* ANSI mode left on -- integer sums raise on overflow instead of wrapping.

Everything else (shuffle partitions, AQE, file split size) is cluster sizing and is read
from the session as the cluster configured it.  ``local_session`` is for tests and the
benchmark only.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

# Sizing defaults for a large cluster; applied only where the cluster left a key unset.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Parquet splits of 256 MiB keep task count manageable at 100 TB (~400k tasks)
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    # HotSpot does not JIT methods over 8,000 bytes of bytecode; report rendering builds wide
    # projections, so let Spark fall back to split expression code for such subtrees only.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Streaming reduce state (one partial row per group) on RocksDB: off-heap, spills to local
    # disk, incremental checkpoints -- the default provider keeps every group on the JVM heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings the engine's semantics depend on."""
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    for key, value in SCALE_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for reliable checkpoints and staged tables.

    Read from ``spark.checkpoint.dir`` (the cluster names a shared filesystem there).
    Only a local-mode session (tests) without one gets a scratch folder; on a cluster an
    unset folder is an error rather than a machine-local fallback.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # a Spark Connect session has no SparkContext; the server side owns it
        if configured:
            return configured
        raise RuntimeError("spark.checkpoint.dir is not set on this session")
    configured = configured or sc.getCheckpointDir()
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: name a folder on the cluster's shared filesystem "
            "(a machine-local folder would not survive an executor loss)"
        )
    local = tempfile.mkdtemp(prefix="tallyspark-ckpt-")
    sc.setCheckpointDir(local)
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder or file through the session's own file systems; absent is fine."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tallyspark") -> SparkSession:
    """Local session for tests and benchmarks (UI off, UTC, AQE)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("TALLY_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**REQUIRED_CONF, **SCALE_CONF}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    checkpoint_dir(spark)
    return spark
