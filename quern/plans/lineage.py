"""Cutting lineage so that a job survives the loss of an executor."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset (local tests) a folder of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="quern-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write once as a columnar table in the shared folder and read it back: later reads prune columns."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession) -> None:
    """Drops shuffle files that nothing refers to any more. Spark deletes them only when the driver's JVM collects garbage, so that those of all steps before would be on disk at once."""
    for _ in range(2):  # Python tells the JVM of its own garbage a little later
        gc.collect()
        time.sleep(0.2)
        spark.sparkContext._jvm.System.gc()
