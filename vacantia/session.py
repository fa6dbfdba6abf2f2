"""Session defaults and the shared working folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def build_session(app_name: str = "vacantia", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are designed for.

    AQE coalesces small shuffle partitions and splits skewed ones at run time, so
    ``spark.sql.shuffle.partitions`` may be set generously on a cluster.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh path for tables and stream checkpoints that must outlive an executor.

    The base is the shared folder the cluster names in ``spark.checkpoint.dir``, or the warehouse
    where none is named. Both are folders that driver and executors share.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/vacantia/{label}-{uuid.uuid4().hex}"
