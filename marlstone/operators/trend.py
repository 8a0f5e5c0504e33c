"""Straight-line trends by group, their back-test and forecast bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Z = 1.28


def _lines(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def backtest(df: DataFrame, keys: Sequence[str], x: str, y: str, most_held: int = 6) -> DataFrame:
    """(keys, points, held, mae, rmse, mape): the last third, most_held at most, forecast from the rest; four points at least."""
    w = Window.partitionBy(*keys)
    placed = df.withColumn("_r", F.row_number().over(w.orderBy(F.desc(x)))).withColumn("points", F.count("*").over(w)).where("points >= 4")
    placed = placed.withColumn("held", F.least(F.lit(most_held), F.greatest(F.lit(1), F.floor(F.col("points") / 3).cast("int")))).where("points - held >= 2")
    lines = _lines(placed.where("_r > held"), keys, x, y)
    error = F.col("slope") * F.col(x) + F.col("intercept") - F.col(y)
    return (
        placed.where("_r <= held")
        .join(lines, list(keys))
        .groupBy(*keys)
        .agg(
            F.max("points").cast("long").alias("points"),
            F.max("held").cast("long").alias("held"),
            F.avg(F.abs(error)).alias("mae"),
            F.sqrt(F.avg(error * error)).alias("rmse"),
            F.avg(F.when(F.col(y) != 0, F.abs(error) / F.abs(F.col(y)) * 100)).alias("mape"),
        )
    )


def forecast(df: DataFrame, keys: Sequence[str], x: str, y: str, horizon: int = 3, low: float = 10.0, high: float = 100.0) -> DataFrame:
    """(keys, x, value, lo, hi) for the steps after the last x: the trend, and a band that widens with the step's root."""
    tested = backtest(df, keys, x, y).select(*keys, F.when(F.col("rmse") > 0, F.col("rmse")).otherwise(2.0).alias("rmse"))
    lines = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.max(x).alias("_last"))
    ahead = lines.join(tested, list(keys)).withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    at = F.col("_last") + F.col("_step")
    value = F.least(F.greatest(F.col("slope") * at + F.col("intercept"), F.lit(low)), F.lit(high))
    band = Z * F.col("rmse") * F.sqrt(F.col("_step"))
    return ahead.select(*keys, at.cast("long").alias(x), value.alias("value"), F.greatest(value - band, F.lit(low / 2)).alias("lo"), F.least(value + band, F.lit(high)).alias("hi"))
