"""Tables written to a folder that driver and executors share, so that lineage ends there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path under the folder in spark.checkpoint.dir; a session in one process gets a folder of its own where that is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("footage_lake.scratch", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("footage_lake.scratch", top)
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def staged(frame: DataFrame) -> DataFrame:
    """Write the rows and read them back."""
    path = shared_folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
