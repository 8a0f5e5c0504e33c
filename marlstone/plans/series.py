"""Series queries: trends, curves, premiums, and events by time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators.curve import pay_curves
from marlstone.operators.hedonic import premiums
from marlstone.operators.trend import backtest, forecast
from marlstone.plans.observations import OBS_SQL, observations
from marlstone.plans.registry import query
from marlstone.sources.scratch import scratch_dir
from marlstone.sources.tables import table
from marlstone.streaming import harness
from marlstone.streaming.events import event_stream, run_available, tumbling

INDEX_SQL = f"""{OBS_SQL}, c AS (SELECT entity, yr, count(*) AS n FROM obs WHERE yr BETWEEN 1995 AND 2000 GROUP BY ALL), s AS (SELECT entity, yr, round(100.0E0 * n / max(n) OVER (PARTITION BY entity), 4) AS v FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY yr DESC) AS r, count(*) OVER (PARTITION BY entity) AS points FROM s), h AS (SELECT *, least(6, greatest(1, points // 3)) AS held FROM p WHERE points >= 4),
l AS (SELECT entity, regr_slope(v, yr) AS b, regr_intercept(v, yr) AS a FROM h WHERE r > held GROUP BY 1),
t AS (SELECT h.entity, max(points) AS points, max(held) AS held, avg(abs(b * yr + a - v)) AS mae, sqrt(avg((b * yr + a - v) ** 2)) AS rmse, avg(CASE WHEN v <> 0 THEN abs(b * yr + a - v) / abs(v) * 100 END) AS mape FROM h JOIN l USING (entity) WHERE r <= held GROUP BY 1)"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A yearly demand index of each entity, 100 at its peak."""
    counts = observations(spark, sf_dir).where("yr between 1995 and 2000").groupBy("entity", "yr").agg(F.count("*").alias("n"))
    return counts.select("entity", "yr", F.round(100.0 * F.col("n") / F.max("n").over(Window.partitionBy("entity")), 4).alias("v"))


@query(f"WITH {INDEX_SQL} SELECT entity, points, held, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(mape, 4) AS mape FROM t")
def forecast_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of each entity's trend on its last years."""
    return backtest(_index(spark, sf_dir), ["entity"], "yr", "v").select("entity", "points", "held", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "mape")])


@query(f"""WITH {INDEX_SQL}, f AS (SELECT entity, regr_slope(v, yr) AS b, regr_intercept(v, yr) AS a, max(yr) AS last FROM s GROUP BY 1), x AS (SELECT f.entity, last + k AS yr, least(greatest(b * (last + k) + a, 10), 100) AS value, 1.28E0 * CASE WHEN rmse > 0 THEN rmse ELSE 2 END * sqrt(k) AS band FROM f JOIN t USING (entity), range(1, 4) r(k))
SELECT entity, CAST(yr AS bigint) AS yr, round(value, 4) AS value, round(greatest(value - band, 5), 4) AS lo, round(least(value + band, 100), 4) AS hi FROM x""")
def trend_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three years ahead, with widening bands."""
    return forecast(_index(spark, sf_dir), ["entity"], "yr", "v").select("entity", "yr", *[F.round(c, 4).alias(c) for c in ("value", "lo", "hi")])


@query()
def pay_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monotone price curves by size band, one for each market and family."""
    low = F.floor((F.col("p_size") - 1) / 5) * 5
    points = observations(spark, sf_dir).groupBy("market", "family", low.cast("double").alias("low")).agg(F.median("unit_price").alias("median"), F.count("*").alias("n")).withColumn("high", F.col("low") + 5)
    return pay_curves(points, ["market", "family"])


@query()
def hedonic_premiums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each word of a part's name adds to its price, all else equal."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = lines.select((F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.array_distinct(F.split("p_name", " ")).alias("skills"), "p_brand", "p_type", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
    return premiums(rows, "price", "skills", ["p_brand", "p_type"], "id", replicas=10)


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.date_format(F.window(F.col("ts").cast("timestamp"), "1 day")["start"], "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH e AS (SELECT event_type, CAST(floor(epoch(ts) / 21600) AS bigint) AS slot FROM events), w AS (SELECT event_type, unnest([slot - 3, slot - 2, slot - 1, slot]) AS s FROM e) SELECT strftime(make_timestamp(s * 21600000000), '%Y-%m-%d %H') AS start, event_type, count(*) AS n FROM w GROUP BY ALL""")
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each day that starts every six hours."""
    w = F.window(F.col("ts").cast("timestamp"), "1 day", "6 hours")
    counts = table(spark, sf_dir, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("start"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user's events with gaps of less than two hours."""
    s = F.session_window(F.col("ts").cast("timestamp"), "2 hours")
    counts = table(spark, sf_dir, "events").groupBy(s.alias("s"), "user_id").agg(F.count("*").alias("n"))
    return counts.select("user_id", F.date_format("s.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("""SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL HAVING count(*) >= 5""")
def category_counts_with_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by category and day, with a floor."""
    days = table(spark, sf_dir, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return days.agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users")).where("n >= 5")


@query("""WITH w AS (SELECT * FROM (VALUES ('click', 1), ('view', 1), ('purchase', 3), ('signup', 3), ('logout', 2)) w(event_type, weight)) SELECT user_id, CAST(sum(coalesce(weight, 1)) AS bigint) AS score FROM events LEFT JOIN w USING (event_type) GROUP BY 1""")
def weighted_event_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user by weight."""
    weight = F.create_map(*[F.lit(x) for kv in (("click", 1), ("view", 1), ("purchase", 3), ("signup", 3), ("logout", 2)) for x in kv])
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.coalesce(F.try_element_at(weight, F.col("event_type")), F.lit(1))).cast("long").alias("score"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily counts again, by a stream over the event files that ends when all are read."""
    folder = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    run_available(tumbling(event_stream(spark, sf_dir)), f"{folder}/out", f"{folder}/checkpoint", "complete")
    return spark.read.parquet(f"{folder}/out").select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


GATE = {"gap_ms": 21_600_000, "burst": 2, "threshold": 2, "reset_ms": 432_000_000, "idle_ms": 172_800_000}


# One row for each request of a host, from the state that the one before left: idle hosts start anew, then credit, breaker, wait, answer.
@query("""WITH RECURSIVE e AS (SELECT coalesce(CAST(user_id AS varchar), '') AS host, event_id, epoch_us(ts) // 1000 AS ms, coalesce(event_type = 'error', false) AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
g AS (SELECT DISTINCT host, CAST(0 AS bigint) AS rn, CAST(NULL AS bigint) AS request_id, CAST(-1 AS bigint) AS credit, CAST(0 AS bigint) AS last_ms, CAST(0 AS bigint) AS fails, CAST(0 AS bigint) AS opened, 'closed' AS state, '' AS outcome, CAST(NULL AS bigint) AS sent_at, CAST(0 AS bigint) AS wait_ms FROM e
UNION ALL SELECT host, rn, event_id, CASE WHEN blocked THEN credit ELSE greatest(0, credit - 21600000) END, CASE WHEN blocked THEN now ELSE now + wait END, CASE WHEN blocked THEN fails WHEN failed THEN fails + 1 ELSE 0 END,
  CASE WHEN opens THEN now + wait ELSE opened END, CASE WHEN blocked OR opens THEN 'open' WHEN failed THEN state ELSE 'closed' END, CASE WHEN blocked THEN 'blocked' WHEN failed THEN 'failed' ELSE 'ok' END, CASE WHEN NOT blocked THEN now + wait END, CASE WHEN blocked THEN 0 ELSE wait END
 FROM (SELECT *, greatest(0, 21600000 - credit) AS wait, NOT blocked AND failed AND (state = 'open' OR fails + 1 >= 2) AS opens
  FROM (SELECT *, state = 'open' AND now - opened < 432000000 AS blocked
   FROM (SELECT host, rn, event_id, failed, greatest(ms, last_ms) AS now, least(43200000, credit + greatest(ms, last_ms) - last_ms) AS credit, fails, opened, state
    FROM (SELECT e.host, e.rn, e.event_id, e.ms, e.failed, CASE WHEN anew THEN 43200000 ELSE g.credit END AS credit, CASE WHEN anew THEN e.ms ELSE g.last_ms END AS last_ms, CASE WHEN anew THEN 0 ELSE g.fails END AS fails, CASE WHEN anew THEN 0 ELSE g.opened END AS opened, CASE WHEN anew THEN 'closed' ELSE g.state END AS state
     FROM (SELECT g.*, e.ms, (g.credit < 0 OR e.ms - g.last_ms >= 172800000) AS anew FROM g JOIN e ON e.host = g.host AND e.rn = g.rn + 1) g JOIN e ON e.host = g.host AND e.rn = g.rn + 1)))))
SELECT host, request_id, outcome, sent_at, wait_ms, state FROM g WHERE rn > 0""")
def polite_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of users: what a bucket and a breaker for each user make of them, as a stream with state."""
    folder = f"{scratch_dir(spark)}/gate-{uuid.uuid4().hex}"
    events = event_stream(spark, sf_dir)
    requests = events.select(F.col("user_id").cast("string").alias("host"), F.col("event_id").alias("request_id"), "ts", (F.col("event_type") == "error").alias("failed"))
    before = harness.rocks_state(spark)
    try:
        run_available(harness.host_gate(requests, **GATE), f"{folder}/out", f"{folder}/checkpoint")
    finally:
        if before is None:
            spark.conf.unset(harness.PROVIDER)
        else:
            spark.conf.set(harness.PROVIDER, before)
    return spark.read.parquet(f"{folder}/out").select("host", "request_id", "outcome", "sent_at", "wait_ms", "state")
