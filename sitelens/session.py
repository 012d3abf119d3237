"""Spark session and shared-folder helpers.

Everything in the library takes a ``SparkSession`` (or DataFrames) as input; this
module only builds a session for tests, the bench and the command line, and
finds the shared folder used for checkpoints and intermediate tables.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def get_spark(app: str = "sitelens", master: str | None = None,
              shuffle_partitions: int | None = None, shared: str | None = None) -> SparkSession:
    """Session tuned for this library: AQE with skew handling, UTC, no UI.

    ``shared`` sets the shared folder where the session has none yet.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or os.environ.get("SITELENS_MASTER", f"local[{cpus}]")
    parts = shuffle_partitions or int(os.environ.get("SITELENS_SHUFFLE_PARTITIONS", cpus))
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SITELENS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # small stores reserve no disk ahead
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints and written tables.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir, which
    tests and the bench set to a folder of their own).  No folder is ever made
    up here: a machine-local one would be lost with its machine.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not conf_dir:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster "
                           "(checkpoints and intermediate tables are written there)")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder (never reused)."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def entries(spark: SparkSession, path: str) -> list[str]:
    """Names of a folder's entries, on whatever store the path is; [] where it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in store.listStatus(at)) if store.exists(at) else []


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that the library itself has written and no longer needs."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
