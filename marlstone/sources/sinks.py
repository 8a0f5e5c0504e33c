"""Writers: full rebuilds behind a pointer, partitioned marts, resumable units."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.readers import or_empty


def publish(tables: Mapping[str, DataFrame], root: str) -> str:
    """Write all tables under a new version and then append a pointer to it; readers see all of it or none.

    Pointers are numbered and never overwritten, so there is one at any time. Two writers at once need a lock of their own.
    """
    version = new_version()
    for name, df in tables.items():
        df.write.parquet(f"{root}/versions/{version}/{name}.parquet")
    append_pointer(next(iter(tables.values())).sparkSession, root, version)
    return version


def new_version() -> str:
    return uuid.uuid4().hex


def append_pointer(spark: SparkSession, root: str, version: str) -> None:
    """Let readers see a version whose tables are all written."""
    pointers = _pointers(spark, root)
    number = pointers.agg(F.max("number")).first()[0] if pointers is not None else None
    spark.createDataFrame([((number or 0) + 1, version)], "number long, version string").coalesce(1).write.mode("append").json(f"{root}/current")


def _pointers(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema("number long, version string").json(f"{root}/current")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def published(spark: SparkSession, root: str) -> str:
    """The folder of the tables that the last pointer names."""
    return f"{root}/versions/{_pointers(spark, root).orderBy(F.desc('number')).first()['version']}"


def delete_by_source(table: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """table without the rows of the sources that new has, and new: a source's rows are replaced as a whole."""
    return table.join(new.select(source).distinct(), source, "left_anti").select(table.columns).unionByName(new)


def consolidate(parts: DataFrame, keys: Sequence[str], order: Sequence[str], path: str) -> DataFrame:
    """The last row of each key over the parts that a job appended, sorted within ranges of the keys; written to path and read again.

    order names the columns that tell the last one; of rows equal in them too, the greatest by all columns is kept.
    """
    rest = [c for c in parts.columns if c not in {*keys, *order}]
    last = parts.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_m"))
    kept = last.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in (*order, *rest)]).select(parts.columns)
    kept.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
    return parts.sparkSession.read.schema(parts.schema).parquet(path)


def export(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """A Parquet table, in folders by columns if any; rows of a folder are gathered before they are written."""
    (df.repartition(*by).write.partitionBy(*by) if by else df.write).mode("overwrite").parquet(path)


def resume_units(spark: SparkSession, units: DataFrame, key: str, out: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Work on the units that are not done yet, append, and give all results; work keeps the key."""
    schema = work(units).schema
    done = or_empty(spark, lambda: spark.read.parquet(out), schema)
    rest = units.join(done.select(key).distinct(), key, "left_anti")
    work(rest).write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)


def audit(df: DataFrame, path: str, what: str) -> None:
    """Append a line of JSON with the row count."""
    df.agg(F.count("*").alias("rows")).withColumn("what", F.lit(what)).write.mode("append").json(path)
