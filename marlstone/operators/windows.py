"""Operators on ordered rows of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.sources.scratch import materialise


def carry(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """value filled forward over the order, and what comes before the first one with the first."""
    w = Window.partitionBy(*keys).orderBy(order)
    back = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), back))


def latest(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """(keys, columns) of the row of the highest order; equal ones by their columns. Needs no sort."""
    best = F.max(F.struct(order, *columns)).alias("_m")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_m.{c}").alias(c) for c in columns])


def momentum(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """(keys, order, value, change): the last period, and its change in per cent from the one before; null without one or from 0."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    prior = F.lead(value).over(w)
    change = F.round((F.col(value) - prior) / F.nullif(prior.cast("double"), F.lit(0.0)) * 100, 1)
    return df.withColumn("change", change).withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keys, order, value, "change")


def top_by(df: DataFrame, keys: Sequence[str], metric: str, tie: str, k: int, name: str) -> DataFrame:
    """(keys, metric name, rank, tie, value): the k highest of each key; null counts as 0."""
    value = F.coalesce(F.col(metric).cast("double"), F.lit(0.0))
    w = Window.partitionBy(*keys).orderBy(F.desc(value), tie)
    ranked = df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
    return ranked.select(*keys, F.lit(name).alias("metric"), "rank", tie, value.alias("value"))


def steps(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """df with step and step_pct from the row before, and climb from the first one."""
    w = Window.partitionBy(*keys).orderBy(order)
    prior, first = F.lag(value).over(w), F.first(value).over(w)
    return df.withColumn("step", F.col(value) - prior).withColumn("step_pct", F.round((F.col(value) - prior) / prior * 100, 1)).withColumn("climb", F.col(value) - first)


def numbered(df: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """df with dense numbers from 1 in the order of columns; rows equal in them get some order.

    Rows are sorted in ranges, not in one task: a range's rows come after the counts of the ranges before it, of
    which there is one row each.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = materialise(ranged, "numbered").withColumn("_range", F.shiftright("_id", 33)).withColumn("_at", F.col("_id") - F.shiftleft("_range", 33))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return ranged.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_id", "_range", "_at", "_before")
