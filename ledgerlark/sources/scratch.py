"""A folder that the driver and all executors see, for tables between jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``; a folder of this machine only where that is unset, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        shared = tempfile.mkdtemp(prefix="scratch-")
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared}/{name}-{uuid.uuid4().hex}"
