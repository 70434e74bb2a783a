"""Paths in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Used only where the session names no shared folder (local runs and tests).
LOCAL_FOLDER = "/tmp/checkpoints"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path of this session below ``spark.checkpoint.dir``, or below a local folder where it is unset and Spark runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(folder or LOCAL_FOLDER).rstrip('/')}/tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
