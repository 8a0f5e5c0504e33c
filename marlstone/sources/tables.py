"""Readers of the star-schema and corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a directory of Parquet tables; any path that Spark can read."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
