"""Session defaults and the scratch folder shared by all executors."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# Result-neutral settings. Partition counts are left to adaptive execution:
# a high initial number is coalesced for small data and kept for large data.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app_name: str = "flowgauge", **extra: str) -> SparkSession:
    """A session with the defaults above; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


SOURCE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def import_on_workers(spark: SparkSession) -> None:
    """Adds the source folder to the path of Python workers; on a cluster the package is installed or sent with ``--py-files``."""
    environment = spark.sparkContext.environment
    paths = [path for path in environment.get("PYTHONPATH", "").split(os.pathsep) if path]
    if SOURCE not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([SOURCE, *paths])


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or else the context's checkpoint folder.

    All executors must share it, so there is no default: a session without either is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared scratch folder; nothing is created yet."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
