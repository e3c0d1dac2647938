"""Intermediate results that are written once and read again."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder path under ``spark.checkpoint.dir``.  Without that setting only a local session gets one, under its temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"tessera-{os.getpid()}")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tessera/{uuid.uuid4().hex}"


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system and path object for a path, so that any store that Spark reaches will do."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()), made


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: what led to it runs once, however often it is read."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
