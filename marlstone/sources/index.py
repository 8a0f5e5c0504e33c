"""Sorted tables whose files' key ranges are known, so that a range of keys opens only the files that may hold it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_index(df: DataFrame, key: str, path: str, files: int) -> None:
    """Write a table in ``files`` ranges of a string key, each sorted, and beside it the least and greatest key of each file.

    A key of very many rows stays in one range; rows of a null key are in the first file and in no range.
    """
    df.repartitionByRange(files, key).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}/rows")
    rows = df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
    ranges = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(key).alias("least"), F.max(key).alias("greatest"))
    ranges.where("least IS NOT NULL").coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")


def key_range(spark: SparkSession, path: str, key: str, prefix: str) -> DataFrame:
    """The rows whose key begins with a prefix; only files whose range meets it are opened, and in them only row groups that do."""
    ranges = spark.read.parquet(f"{path}/ranges")
    begins = lambda c: F.substring(c, 1, len(prefix))  # noqa: E731  of equal length, so texts compare as their beginnings do
    met = ranges.where((begins("least") <= prefix) & (begins("greatest") >= prefix)).select("file").collect()
    rows = spark.read.parquet(f"{path}/rows")
    if not met:
        return rows.limit(0)
    return spark.read.schema(rows.schema).parquet(*[r["file"] for r in met]).where(F.col(key).startswith(prefix))
