"""Session builder with the settings that the library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "marlstone", shuffle_partitions: int | None = None) -> SparkSession:
    """A session with AQE (coalescing and skew joins) on and UTC time.

    On a cluster leave ``master`` out, so that spark-submit decides, and leave
    ``shuffle_partitions`` high: AQE merges small partitions afterwards.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
