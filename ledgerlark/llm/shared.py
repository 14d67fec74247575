"""The folder that driver and executors share, for tables and checkpoints between jobs."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this machine only where that is unset, as in tests."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_to:
        set_to = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(set_to)
    return set_to


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a table in the shared folder, read again: its lineage ends there and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of jobs that are over, which it does, a little later, once their plans are garbage."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def discarded(df: DataFrame) -> None:
    """Removes the files of a table that ``written`` made and that nothing will read again."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
