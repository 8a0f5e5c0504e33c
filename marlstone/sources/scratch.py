"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is ``spark.checkpoint.dir`` of the session, or the checkpoint folder that was
    set on its context. Where neither is, a local master gets a temporary folder; a
    cluster without it is an error, as the executors could not see each other's files.
    """
    context = spark.sparkContext
    if found := spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return found.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: work is done once and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
