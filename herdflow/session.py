"""Spark session defaults and shared-storage helpers.

Cluster settings always win: every helper here only fills a value when the
session leaves it unset, so the same code runs on ``local[8]`` in tests and on a
large cluster where the operator sets shuffle partitions, the checkpoint folder
and memory.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings applied only when the session does not define them yet.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "herdflow",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine's defaults.

    ``master`` and ``shuffle_partitions`` are for local runs; on a cluster
    leave them ``None`` and let the submit configuration decide.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.ui.enabled", "false")
        builder = builder.config("spark.driver.memory", "16g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession) -> None:
    """Fill engine defaults that the session has not set."""
    for key, value in DEFAULT_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


_LOCAL_CHECKPOINT_DIR: str | None = None


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    Reads ``spark.checkpoint.dir`` from the session (the cluster names a shared
    folder there). Where it is unset, a local master (tests) gets a fresh
    scratch folder; on a cluster, whose executors do not share one, an error
    is raised.
    """
    global _LOCAL_CHECKPOINT_DIR
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        # ``spark.checkpoint.dir`` cannot be changed at runtime (Spark 4), so
        # an unset session gets a process-local folder via the SparkContext.
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if _LOCAL_CHECKPOINT_DIR is None:
            _LOCAL_CHECKPOINT_DIR = tempfile.mkdtemp(prefix="herdflow-ckpt-")
        configured = _LOCAL_CHECKPOINT_DIR
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path under the shared checkpoint folder (never machine-local
    on a cluster)."""
    base = checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")
