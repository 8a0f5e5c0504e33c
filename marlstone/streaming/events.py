"""Streams of event files: windows, late data, repeats and state; each can resume where it stopped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", late: str = "2 days") -> DataFrame:
    """Events of files as they land; those later than ``late`` are dropped."""
    stream = spark.readStream.schema(SCHEMA).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(stream: DataFrame, size: str = "1 day") -> DataFrame:
    return stream.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(stream: DataFrame, size: str = "1 day", step: str = "6 hours") -> DataFrame:
    return stream.groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, gap: str = "2 hours") -> DataFrame:
    return stream.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def without_repeats(stream: DataFrame) -> DataFrame:
    """Each event id once within the watermark."""
    return stream.dropDuplicatesWithinWatermark(["event_id"])


def breaker(stream: DataFrame, limit: int = 3) -> DataFrame:
    """(user_id, events, open): a user's events so far, and whether ``limit`` of one batch in a row were errors."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, failed = state.get if state.exists else (0, 0)
        for b in batches:
            for kind in b.sort_values("ts")["event_type"]:
                seen, failed = seen + 1, failed + 1 if kind == "error" else 0
        state.update((seen, failed))
        yield pd.DataFrame({"user_id": [key[0]], "events": [seen], "open": [failed >= limit]})

    return stream.groupBy("user_id").applyInPandasWithState(update, "user_id long, events long, open boolean", "seen long, failed long", "update", GroupStateTimeout.NoTimeout)


def run_available(result: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what has landed and stop; the next call goes on from there. Complete results replace the table.

    Other results have a folder for each batch, and a column ``batch``: a batch that is tried again replaces its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    result.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
