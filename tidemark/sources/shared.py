"""Folders that the driver and all executors see."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; without it there is none that all machines share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder in it."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
