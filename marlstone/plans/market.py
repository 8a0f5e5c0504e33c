"""Market queries: cells, lenses, scores, fusion and serving over the order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.score import growth, min_max, nice, per_cent_change, sqrt_index
from marlstone.functions.text import confidence, experience_band
from marlstone.operators.aggregate import counted_median, known_share, medians, mode_first_seen, nearest_rank, pair_counts, top_items, upper_median, with_pooled, with_total
from marlstone.operators import gate
from marlstone.operators.lookup import overlap_ranking, two_level
from marlstone.operators.upsert import append_new, by_priority, fill_gaps, first_wins, last_wins, pick, update_values
from marlstone.operators.windows import carry, latest, momentum, steps, top_by
from marlstone.plans.observations import OBS_SQL, line_bound, observations
from marlstone.plans.registry import ORACLES, query
from marlstone.sources.scratch import materialise
from marlstone.sources.tables import table

LAST = 2000


def long(c: str) -> F.Column:
    return F.col(c).cast("long").alias(c)


def _scored(cell: DataFrame, prices: DataFrame) -> DataFrame:
    """The score board of cells (entity, market, med, demand, interest), with parities from prices (market, s, c): sums and numbers of all prices."""
    overall = prices.agg((F.sum("s") / F.sum("c")).alias("a"))
    # One row, so this adds a column to the markets.
    ppp = prices.join(F.broadcast(overall), F.lit(True)).select("market", (F.col("s") / F.col("c") / F.col("a")).alias("pf"))
    v = cell.join(ppp, "market", "left").select("entity", "market", F.col("demand").cast("double").alias("d"), F.col("interest").cast("double").alias("i"), (F.col("med") / F.coalesce(F.nullif("pf", F.lit(0.0)), F.lit(1.0))).alias("s"))
    z = v.select("entity", "market", *[min_max(F.col(c), "market").alias(c) for c in "dis"])
    z = z.withColumn("s01", F.round(0.42 * F.col("d") + 0.25 * (1 - F.col("i")) + 0.33 * F.col("s"), 9))
    w = Window.partitionBy("market")
    z = z.withColumn("rank", F.row_number().over(w.orderBy(F.desc("s01"), "entity")).cast("long")).withColumn("n", F.count("*").over(w))
    ten = lambda c, name: F.round(c * 10, 1).alias(name)
    return z.select("entity", "market", ten(F.col("s01"), "total"), ten(F.col("d"), "demand_score"), ten(F.col("s"), "pay_score"), ten(1 - F.col("i"), "opp_score"), "rank", F.greatest(F.lit(1), F.round((F.col("rank") - 1) * 100.0 / F.col("n")).cast("long")).alias("pctile"))


@query(f"""WITH {OBS_SQL}, o AS (SELECT obs.*, o_custkey FROM obs LEFT JOIN orders ON l_orderkey = o_orderkey),
cell AS (SELECT entity, market, median(unit_price) AS med, count(*) AS demand, count(DISTINCT o_custkey) AS interest FROM o WHERE yr = {LAST} GROUP BY entity, market HAVING count(*) >= 5),
ppp AS (SELECT market, avg(unit_price) / (SELECT avg(unit_price) FROM o) AS pf FROM o GROUP BY market),
v AS (SELECT c.entity, c.market, c.demand * 1.0E0 AS d, c.interest * 1.0E0 AS i, c.med / coalesce(nullif(p.pf, 0), 1.0E0) AS s FROM cell c LEFT JOIN ppp p ON c.market = p.market),
b AS (SELECT *, min(d) OVER w AS d0, max(d) OVER w AS d1, min(i) OVER w AS i0, max(i) OVER w AS i1, min(s) OVER w AS s0, max(s) OVER w AS s1, count(*) OVER w AS n FROM v WINDOW w AS (PARTITION BY market)),
z AS (SELECT entity, market, n, CASE WHEN d1 = d0 THEN 0.5E0 ELSE (d - d0) / (d1 - d0) END AS dn, CASE WHEN i1 = i0 THEN 0.5E0 ELSE (i - i0) / (i1 - i0) END AS inn, CASE WHEN s1 = s0 THEN 0.5E0 ELSE (s - s0) / (s1 - s0) END AS sn FROM b),
t AS (SELECT *, round(0.42E0 * dn + 0.25E0 * (1 - inn) + 0.33E0 * sn, 9) AS s01 FROM z),
r AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY s01 DESC, entity) AS rk FROM t)
SELECT entity, market, round(s01 * 10, 1) AS total, round(dn * 10, 1) AS demand_score, round(sn * 10, 1) AS pay_score, round((1 - inn) * 10, 1) AS opp_score,
       CAST(rk AS bigint) AS rank, CAST(greatest(1, round((rk - 1) * 100.0E0 / n)) AS bigint) AS pctile FROM r""")
def job_score_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite score, rank and percentile of each entity within its market."""
    obs = observations(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = obs.where(F.col("yr") == LAST).join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    cell = medians(lines, ["entity", "market"], {"med": F.col("unit_price")}, [F.count("*").alias("demand"), F.count_distinct("o_custkey").alias("interest")], line_bound(spark, sf_dir)).where("demand >= 5")
    prices = obs.groupBy("market").agg(F.sum("unit_price").alias("s"), F.count("*").alias("c"))
    return _scored(cell, prices)


@query(f"""WITH {OBS_SQL}, c AS (SELECT entity, market, yr, round(median(unit_price), 4) AS median, count(*) AS n FROM obs WHERE unit_price BETWEEN 100 AND 100000 GROUP BY ALL HAVING count(*) >= 5)
SELECT entity, market, yr, median, n, CASE WHEN n >= 200 THEN 'high' WHEN n >= 40 THEN 'medium' ELSE 'low' END AS confidence FROM c""")
def salary_cell_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of each cell of five rows and more, with its confidence tier."""
    rows = observations(spark, sf_dir).where(F.col("unit_price").between(100, 100_000))
    cells = medians(rows, ["entity", "market", "yr"], {"median": F.col("unit_price")}, [F.count("*").alias("n")], line_bound(spark, sf_dir)).where("n >= 5")
    return cells.withColumn("median", F.round("median", 4)).withColumn("confidence", confidence(F.col("n"), 200, 40))


@query(f"""WITH {OBS_SQL}, b AS (SELECT *, CASE WHEN l_quantity <= 2 THEN '0-2' WHEN l_quantity <= 5 THEN '3-5' WHEN l_quantity <= 9 THEN '6-9' ELSE '10+' END AS band FROM obs)
SELECT entity, yr, CASE WHEN grouping(band) = 1 THEN 'pooled' ELSE band END AS band, round(median(unit_price), 4) AS median, count(*) AS n FROM b GROUP BY GROUPING SETS ((entity, yr, band), (entity, yr)) HAVING count(*) >= 5""")
def pooled_and_banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians by experience band and pooled over all bands, in one pass."""
    rows = observations(spark, sf_dir).withColumn("band", experience_band(F.col("l_quantity")))
    return with_pooled(rows, ["entity", "yr"], "band", [F.round(F.median("unit_price"), 4).alias("median"), F.count("*").alias("n")]).where("n >= 5")


@query(f"""WITH {OBS_SQL} SELECT CASE WHEN grouping(entity) = 1 THEN '*' ELSE entity END AS entity, round(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END), 0), 4) AS share, count(*) AS n
FROM obs GROUP BY ROLLUP (entity) HAVING count(*) >= 8""")
def global_and_entity_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag's share among known ones, by entity and over all ('*')."""
    flag = F.col("l_returnflag")
    return with_total(observations(spark, sf_dir), "entity", [known_share(flag == "R", flag != "N").alias("share"), F.count("*").alias("n")]).where("n >= 8")


@query(f"""WITH {OBS_SQL}, l AS (SELECT entity, market, list_sort(list(l_quantity)) AS v, count(*) AS n FROM obs WHERE l_quantity IS NOT NULL GROUP BY ALL)
SELECT entity, market, n, v[CAST(round_even(0.1E0 * (n - 1), 0) AS bigint) + 1] AS p10, v[CAST(round_even(0.5E0 * (n - 1), 0) AS bigint) + 1] AS p50, v[CAST(round_even(0.9E0 * (n - 1), 0) AS bigint) + 1] AS p90 FROM l""")
def nearest_rank_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles, from counts of distinct values."""
    return nearest_rank(observations(spark, sf_dir), ["entity", "market"], "l_quantity", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


@query(f"""WITH {OBS_SQL}, y AS (SELECT *, max(yr) OVER (PARTITION BY entity) AS last FROM obs), l AS (SELECT entity, list_sort(list(l_quantity)) AS v, count(*) AS n FROM y WHERE yr = last GROUP BY entity)
SELECT entity, n, v[n // 2 + 1] AS upper_median FROM l""")
def latest_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median of each entity's latest year."""
    obs = observations(spark, sf_dir).select("entity", "yr", "l_quantity")
    last = obs.groupBy("entity").agg(F.max("yr").alias("yr"))
    return upper_median(obs.join(last, ["entity", "yr"]), ["entity"], "l_quantity")


@query(f"""WITH {OBS_SQL}, b AS (SELECT entity, CASE WHEN l_quantity < 2 THEN '0-2' WHEN l_quantity < 4 THEN '2-4' WHEN l_quantity < 7 THEN '4-7' WHEN l_quantity < 10 THEN '7-10' ELSE '10+' END AS bucket, count(*) AS n FROM obs GROUP BY ALL)
SELECT entity, bucket, n, round(n / sum(n) OVER (PARTITION BY entity), 4) AS share FROM b""")
def bucket_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and share of half-open ranges; empty ones have no row."""
    q = F.col("l_quantity")
    bucket = F.when(q < 2, "0-2").when(q < 4, "2-4").when(q < 7, "4-7").when(q < 10, "7-10").otherwise("10+")
    counts = observations(spark, sf_dir).groupBy("entity", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("entity")), 4))


@query(f"""WITH {OBS_SQL}, c AS (SELECT market, entity, count(*) AS n FROM obs GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY n DESC, entity) AS r FROM c)
SELECT market, CAST(to_json(list(entity ORDER BY r)) AS varchar) AS items FROM r WHERE r <= 6 GROUP BY market""")
def topk_items_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six most frequent entities of each market, as a JSON list."""
    return top_items(observations(spark, sf_dir), ["market"], "entity", 6)


@query(f"""WITH {OBS_SQL}, c AS (SELECT entity, market, count(*) AS n FROM obs WHERE yr = {LAST} GROUP BY ALL)
SELECT entity, market, n, round(100 * sqrt(n / max(n) OVER (PARTITION BY market))) AS demand_index FROM c""")
def demand_sqrt_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts on a root scale of the market's largest."""
    counts = observations(spark, sf_dir).where(F.col("yr") == LAST).groupBy("entity", "market").agg(F.count("*").alias("n"))
    return counts.withColumn("demand_index", sqrt_index(F.col("n"), F.max("n").over(Window.partitionBy("market"))))


FEEDS_SQL = f"""{OBS_SQL}, feeds AS (
  SELECT entity, market, yr, 'lines' AS source, 1 AS rank, count(*) AS v FROM obs WHERE l_returnflag = 'R' GROUP BY ALL
  UNION ALL SELECT entity, market, yr, 'orders', 0, count(DISTINCT l_orderkey) FROM obs WHERE l_returnflag = 'A' AND l_quantity > 40 GROUP BY ALL
  UNION ALL SELECT entity, market, yr, 'seed', 5, CAST(count(*) AS bigint) FROM obs GROUP BY ALL)"""


def _feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs, keys = observations(spark, sf_dir), ["entity", "market", "yr"]
    feed = lambda df, source, rank, value: df.groupBy(*keys).agg(value.alias("v")).select(*keys, F.lit(source).alias("source"), F.lit(rank).alias("rank"), "v")
    return (
        feed(obs.where("l_returnflag = 'R'"), "lines", 1, F.count("*"))
        .unionByName(feed(obs.where("l_returnflag = 'A' and l_quantity > 40"), "orders", 0, F.count_distinct("l_orderkey")))
        .unionByName(feed(obs, "seed", 5, F.count("*")))
    )


@query(f"WITH {FEEDS_SQL} SELECT entity, market, yr, source, rank, v FROM feeds QUALIFY row_number() OVER (PARTITION BY entity, market, yr ORDER BY rank, source) = 1")
def demand_priority_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several feeds of a cell the one of the best source."""
    return by_priority(_feeds(spark, sf_dir), ["entity", "market", "yr"], "rank", ["source"])


@query(f"""WITH {OBS_SQL}, a AS (SELECT entity, market, yr, 'survey' AS source, count(*) AS n FROM obs WHERE l_quantity > 25 GROUP BY ALL HAVING count(*) >= 5), b AS (SELECT entity, market, yr, 'filing' AS source, count(*) AS n FROM obs GROUP BY ALL)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.entity = b.entity AND a.market = b.market AND a.yr = b.yr)""")
def authoritative_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The authoritative source's cells; the other's only where it has none."""
    obs, keys = observations(spark, sf_dir), ["entity", "market", "yr"]
    cells = lambda df, s: df.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.lit(s).alias("source"), "n")
    return fill_gaps(cells(obs.where("l_quantity > 25"), "survey").where("n >= 5"), cells(obs, "filing"), keys)


@query(f"WITH {FEEDS_SQL}, e AS (SELECT entity, market, yr, source, v FROM feeds WHERE source = 'lines'), n AS (SELECT entity, market, yr, source, v FROM feeds WHERE source <> 'lines') SELECT * FROM e UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.entity = n.entity AND e.market = n.market AND e.yr = n.yr) QUALIFY row_number() OVER (PARTITION BY entity, market, yr ORDER BY source) = 1")
def upsert_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows only for keys that aren't there; the first of each."""
    feeds = _feeds(spark, sf_dir).drop("rank")
    return first_wins(feeds.where("source = 'lines'"), feeds.where("source <> 'lines'"), ["entity", "market", "yr"], ["source"])


@query(f"WITH {FEEDS_SQL}, n AS (SELECT entity, market, yr, source, v FROM feeds WHERE source <> 'seed' QUALIFY row_number() OVER (PARTITION BY entity, market, yr ORDER BY source DESC) = 1) SELECT * FROM n UNION ALL SELECT entity, market, yr, source, v FROM feeds e WHERE source = 'seed' AND NOT EXISTS (SELECT 1 FROM n WHERE e.entity = n.entity AND e.market = n.market AND e.yr = n.yr)")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows replace those of their key; the last of each."""
    feeds = _feeds(spark, sf_dir).drop("rank")
    return last_wins(feeds.where("source = 'seed'"), feeds.where("source <> 'seed'"), ["entity", "market", "yr"], [F.desc("source")])


@query("WITH m AS (SELECT o_orderpriority AS id, min(year(o_orderdate)) AS y FROM orders GROUP BY ALL) SELECT c_mktsegment AS segment, CAST(round(sum(c_acctbal), 2) AS double) AS total, count(*) AS n FROM (SELECT c_custkey, c_mktsegment, coalesce(o.t, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS t FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON c_custkey = o_custkey) GROUP BY 1")
def point_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values replaced for the keys that have a new one, then summed."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    updated = update_values(customer, new, ["c_custkey"], "c_acctbal")
    return updated.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.round(F.sum("c_acctbal"), 2).alias("total"), F.count("*").alias("n"))


LENS_SQL = f"""{OBS_SQL}, adv AS (SELECT entity, market, yr, round(median(unit_price), 4) AS m, count(*) AS n FROM obs WHERE l_returnflag = 'N' GROUP BY ALL),
real AS (SELECT entity, market, yr, round(median(realized_price), 4) AS m, count(*) AS n FROM obs WHERE l_returnflag = 'R' GROUP BY ALL), off AS (SELECT entity, market, yr, round(median(p_retailprice), 4) AS m, count(*) AS n FROM obs WHERE l_returnflag = 'A' GROUP BY ALL),
keys AS (SELECT entity, market, yr FROM adv UNION SELECT entity, market, yr FROM real UNION SELECT entity, market, yr FROM off),
spine AS (SELECT k.entity, k.market, k.yr, adv.m AS advertised, CASE WHEN real.n >= 30 THEN real.m END AS realized, off.m AS official, adv.n AS adv_n, real.n AS real_n, off.n AS off_n
  FROM keys k LEFT JOIN adv USING (entity, market, yr) LEFT JOIN real USING (entity, market, yr) LEFT JOIN off USING (entity, market, yr))"""


def _lenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three price lenses side by side, realized ones of fewer than 30 rows suppressed. One aggregate makes all."""
    flag = F.col("l_returnflag")
    of = lambda f, c: F.when(flag == f, F.col(c))
    values = {"advertised": of("N", "unit_price"), "realized": of("R", "realized_price"), "official": of("A", "p_retailprice")}
    counts = [F.nullif(F.count(F.when(flag == f, 1)), F.lit(0)).alias(name) for f, name in (("N", "adv_n"), ("R", "real_n"), ("A", "off_n"))]
    cells = medians(observations(spark, sf_dir).where(flag.isin("N", "R", "A")), ["entity", "market", "yr"], values, counts, line_bound(spark, sf_dir))
    cells = cells.withColumns({c: F.round(c, 4) for c in values})
    return cells.withColumn("realized", F.when(F.col("real_n") >= 30, F.col("realized")))


@query(f"""WITH {LENS_SQL} SELECT entity, market, yr, advertised, realized, official, coalesce(advertised, realized, official) AS headline,
CASE WHEN advertised IS NOT NULL THEN 'advertised' WHEN realized IS NOT NULL THEN 'realized' WHEN official IS NOT NULL THEN 'official' END AS headline_lens,
CASE WHEN advertised IS NOT NULL THEN adv_n WHEN realized IS NOT NULL THEN real_n WHEN official IS NOT NULL THEN off_n END AS headline_n FROM spine""")
def union_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lenses of each key, never blended, and the headline with its own provenance."""
    named = lambda v, name, n: F.when(F.col(v).isNotNull(), F.struct(F.col(v).alias("m"), F.lit(name).alias("l"), F.col(n).alias("n")))
    head = F.coalesce(named("advertised", "advertised", "adv_n"), named("realized", "realized", "real_n"), named("official", "official", "off_n"))
    s = _lenses(spark, sf_dir).withColumn("h", head)
    return s.select("entity", "market", "yr", "advertised", "realized", "official", F.col("h.m").alias("headline"), F.col("h.l").alias("headline_lens"), F.col("h.n").alias("headline_n"))


@query(f"""WITH {OBS_SQL}, anchor AS (SELECT entity, median(unit_price) AS a FROM obs GROUP BY entity), c AS (SELECT entity, market, yr, month, median(unit_price) AS v FROM obs GROUP BY ALL)
SELECT entity, market, yr, month, round(v, 4) AS value FROM c LEFT JOIN anchor USING (entity) WHERE a IS NULL OR v BETWEEN 0.9 * a AND 1.1 * a""")
def sanity_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells within a band about their entity's anchor; without an anchor all stay."""
    obs = observations(spark, sf_dir)
    bound = line_bound(spark, sf_dir)
    anchor = counted_median(obs, ["entity"], "unit_price", "a", bound=bound).drop("n")
    cells = medians(obs, ["entity", "market", "yr", "month"], {"v": F.col("unit_price")}, bound=bound)
    kept = cells.join(anchor, "entity", "left").where("a is null or v between 0.9 * a and 1.1 * a")
    return kept.select("entity", "market", "yr", "month", F.round("v", 4).alias("value"))


PULSE_SQL = f"""{OBS_SQL}, c AS (SELECT market, entity, count(*) FILTER (yr = {LAST}) AS demand, round(median(unit_price) FILTER (yr = {LAST}), 4) AS pay, count(*) FILTER (yr = {LAST}) - count(*) FILTER (yr = {LAST} - 5) AS rise FROM obs GROUP BY ALL)"""


@query(f"""WITH {PULSE_SQL}, u AS (SELECT market, 'hottest' AS metric, entity, demand * 1.0E0 AS value FROM c UNION ALL SELECT market, 'topPay', entity, coalesce(pay, 0) FROM c UNION ALL SELECT market, 'rising', entity, rise * 1.0E0 FROM c
UNION ALL SELECT market, 'topScore', entity, total FROM ({ORACLES['job_score_board']}))
SELECT market, metric, row_number() OVER (PARTITION BY market, metric ORDER BY value DESC, entity) AS rank, entity, value FROM u QUALIFY rank <= 5""")
def market_pulse_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five leaders of each market by four metrics."""
    last = lambda c: F.when(F.col("yr") == LAST, c)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = observations(spark, sf_dir).join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    counts = [F.count(last(F.lit(1))).alias("demand"), F.count_distinct(last(F.col("o_custkey"))).alias("interest"), F.count(F.when(F.col("yr") == LAST - 5, 1)).alias("before"), F.sum("unit_price").alias("s"), F.count("*").alias("c")]
    cells = materialise(medians(lines, ["market", "entity"], {"med": last(F.col("unit_price"))}, counts, line_bound(spark, sf_dir)), "pulse")
    cells = cells.withColumns({"pay": F.round("med", 4), "rise": F.col("demand") - F.col("before")})
    top = [top_by(cells, ["market"], c, "entity", 5, name) for c, name in (("demand", "hottest"), ("pay", "topPay"), ("rise", "rising"))]
    board = _scored(cells.where("demand >= 5").select("entity", "market", "med", "demand", "interest"), cells.groupBy("market").agg(F.sum("s").alias("s"), F.sum("c").alias("c")))
    scores = top_by(board, ["market"], "total", "entity", 5, "topScore")
    return top[0].unionByName(top[1]).unionByName(top[2]).unionByName(scores)


@query("""WITH m AS (SELECT o_orderpriority AS feed, strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n FROM orders GROUP BY ALL)
SELECT feed, period, n AS value, round((n - prior) / nullif(prior, 0) * 100, 1) AS change FROM (SELECT *, lead(n) OVER (PARTITION BY feed ORDER BY period DESC) AS prior, row_number() OVER (PARTITION BY feed ORDER BY period DESC) AS r FROM m) WHERE r = 1""")
def adoption_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest period's count and its change from the one before."""
    months = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("feed"), F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(F.count("*").alias("value"))
    return momentum(months, ["feed"], "period", "value")


@query(f"""WITH {LENS_SQL} SELECT entity, market, yr, realized, real_n AS n FROM spine WHERE real_n IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity, market ORDER BY yr DESC) = 1""")
def latest_lens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest year of a lens."""
    rows = _lenses(spark, sf_dir).where("real_n is not null").select("entity", "market", "yr", "realized", F.col("real_n").alias("n"))
    return latest(rows, ["entity", "market"], "yr", ["realized", "n"]).join(rows.groupBy("entity", "market").agg(F.max("yr").alias("yr")), ["entity", "market"])


@query(f"""WITH {OBS_SQL}, g AS (SELECT market, yr, sum(CAST(round(unit_price * 100) AS bigint)) / count(*) / 100 AS v FROM obs WHERE p_size > 48 GROUP BY ALL HAVING count(*) >= 2), k AS (SELECT DISTINCT market, yr FROM obs), j AS (SELECT k.market, k.yr, v FROM k LEFT JOIN g USING (market, yr))
SELECT market, yr, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY market ORDER BY yr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER (PARTITION BY market ORDER BY yr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS ppp FROM j""")
def ppp_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A yearly factor carried into years without one."""
    obs = observations(spark, sf_dir)
    seen, cents = F.col("p_size") > 48, F.round(F.col("unit_price") * 100).cast("long")
    factors = obs.groupBy("market", "yr").agg(F.when(F.count(F.when(seen, 1)) >= 2, F.sum(F.when(seen, cents)) / F.count(F.when(seen, 1)) / 100).alias("ppp"))
    return carry(factors, ["market"], "yr", "ppp")


@query(f"""WITH {OBS_SQL}, r AS (SELECT family, CAST((p_size - 1) // 10 + 1 AS bigint) AS level, median(unit_price) AS m, count(*) AS n FROM obs GROUP BY ALL HAVING count(*) >= 30), q AS (SELECT *, count(*) OVER (PARTITION BY family) AS k FROM r)
SELECT family, level, n, round(m, 4) AS median, round(m - lag(m) OVER w, 4) AS step, round((m - lag(m) OVER w) / lag(m) OVER w * 100, 1) AS step_pct, round(m - first_value(m) OVER w, 4) AS climb FROM q WHERE k >= 2 WINDOW w AS (PARTITION BY family ORDER BY level)""")
def promotion_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians by level, the steps between them and the climb from the first."""
    level = (F.floor((F.col("p_size") - 1) / 10) + 1).cast("long")
    rungs = counted_median(observations(spark, sf_dir).withColumn("level", level), ["family", "level"], "unit_price", bound=line_bound(spark, sf_dir)).where("n >= 30")
    rungs = rungs.withColumn("_k", F.count("*").over(Window.partitionBy("family"))).where("_k >= 2").drop("_k")
    found = steps(rungs, ["family"], "level", "median")
    return found.select("family", "level", "n", *[F.round(c, 4).alias(c) for c in ("median", "step", "climb")], "step_pct")


@query(f"""WITH {OBS_SQL}, l AS (SELECT entity, market FROM obs WHERE yr <= 1998 GROUP BY ALL), f AS (SELECT entity, market, min(yr) AS born, count(*) AS n FROM obs WHERE yr > 1998 AND l_quantity > 48 GROUP BY ALL)
SELECT entity, market, born, n FROM f ANTI JOIN (SELECT * FROM l WHERE entity > 'Brand#3') l USING (entity, market)""")
def ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a birth ledger has to take up: pairs that it doesn't hold yet."""
    obs = observations(spark, sf_dir)
    ledger = obs.where("yr <= 1998 and entity > 'Brand#3'").select("entity", "market").distinct()
    found = obs.where("yr > 1998 and l_quantity > 48").groupBy("entity", "market").agg(F.min("yr").alias("born"), F.count("*").alias("n"))
    return append_new(ledger, found, ["entity", "market"])


@query(f"WITH {OBS_SQL} SELECT l_partkey AS part, count(DISTINCT n_regionkey) AS regions FROM obs GROUP BY 1 HAVING count(DISTINCT n_regionkey) = (SELECT count(*) FROM region)")
def relational_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that are sold from every region."""
    counts = observations(spark, sf_dir).groupBy(F.col("l_partkey").alias("part")).agg(F.count_distinct("n_regionkey").alias("regions"))
    every = table(spark, sf_dir, "region").agg(F.count("*").alias("every"))
    return counts.join(F.broadcast(every), F.col("regions") == F.col("every")).select("part", "regions")


@query("SELECT o_custkey AS customer, o_orderstatus AS status, o_orderkey AS first_order, o_orderpriority AS priority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) = 1")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order of each customer and status."""
    first = pick(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"])
    return first.select(F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("first_order"), F.col("o_orderpriority").alias("priority"))


@query("SELECT o_custkey AS customer, o_orderkey AS last_order, round(o_totalprice, 2) AS price FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def dedup_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of each customer, by one maximum."""
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("m"))
    return last.select("customer", F.col("m.o_orderkey").alias("last_order"), F.round("m.o_totalprice", 2).alias("price"))


@query("""SELECT o_custkey AS customer, o_orderkey AS order_id, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) = 1 AS is_unique, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS dup_group FROM orders""")
def first_occurrence_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an order is its group's first, and the group's id."""
    w = Window.partitionBy("o_custkey", "o_orderpriority")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("order_id"), (F.min("o_orderkey").over(w) == F.col("o_orderkey")).alias("is_unique"), F.min("o_orderkey").over(w).alias("dup_group"))


@query("""WITH i AS (SELECT DISTINCT l_orderkey AS o, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT o FROM i GROUP BY o HAVING count(*) BETWEEN 2 AND 5)
SELECT x.b AS a, y.b AS b, count(*) AS n FROM i x JOIN i y ON x.o = y.o AND x.b < y.b WHERE x.o IN (SELECT o FROM n) GROUP BY 1, 2 HAVING count(*) >= 5""")
def cooccurrence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands ordered together, in orders of 2 to 5 brands."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return pair_counts(lines.select(F.col("l_orderkey").alias("o"), F.col("p_brand").alias("item")), "o", "item", 5)


@query(f"WITH {OBS_SQL}, f AS (SELECT 'line' AS fact, l_returnflag AS source, count(*) AS n FROM obs GROUP BY ALL UNION ALL SELECT 'order', o_orderpriority, count(*) FROM orders GROUP BY ALL UNION ALL SELECT 'event', event_type, count(*) FROM events GROUP BY ALL UNION ALL SELECT 'customer', c_mktsegment, count(*) FROM customer GROUP BY ALL) SELECT fact, source, n, round(n / sum(n) OVER (PARTITION BY fact), 4) AS share FROM f")
def provenance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by fact and source, and the source's share."""
    parts = [("line", observations(spark, sf_dir), "l_returnflag"), ("order", table(spark, sf_dir, "orders"), "o_orderpriority"), ("event", table(spark, sf_dir, "events"), "event_type"), ("customer", table(spark, sf_dir, "customer"), "c_mktsegment")]
    counts = [df.groupBy(F.lit(fact).alias("fact"), F.col(c).alias("source")).agg(F.count("*").alias("n")) for fact, df, c in parts]
    every = counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])
    return every.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("fact")), 4))


@query(f"""WITH {OBS_SQL}, c AS (SELECT DISTINCT entity AS code, family FROM obs), t AS (SELECT substr(p_brand, 1, 7) || '-' || CAST(p_size AS varchar) AS code, min(p_type) AS family FROM part WHERE p_size > 25 GROUP BY 1 UNION ALL SELECT substr(p_brand, 1, 7), max(p_type) FROM part GROUP BY 1),
p AS (SELECT p_partkey, substr(p_brand, 1, 7) || '-' || CAST(p_size AS varchar) AS code FROM part) SELECT p_partkey AS part, p.code, coalesce(e.family, b.family) AS family FROM p LEFT JOIN t e ON p.code = e.code LEFT JOIN t b ON substr(p.code, 1, 7) = b.code""")
def crosswalk_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code's value, or that of its base."""
    part = table(spark, sf_dir, "part")
    base, code = F.substring("p_brand", 1, 7), F.concat_ws("-", F.substring("p_brand", 1, 7), "p_size")
    codes = part.where("p_size > 25").groupBy(code.alias("code")).agg(F.min("p_type").alias("family")).unionByName(part.groupBy(base.alias("code")).agg(F.max("p_type").alias("family")))
    return two_level(part.select(F.col("p_partkey").alias("part"), code.alias("code")), "code", codes, 7, "family").select("part", "code", "family")


@query("""WITH w AS (SELECT DISTINCT p_brand AS entity, unnest(string_split(p_name, ' ')) AS skill FROM part), l AS (SELECT l_suppkey AS supplier, unnest(string_split(p_name, ' ')) AS skill FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT w.entity, count(*) AS n FROM l JOIN w USING (skill) GROUP BY 1""")
def skill_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by entity over a bridge from one to many; lines are counted by skill before they fan out."""
    part = table(spark, sf_dir, "part").withColumn("skill", F.explode(F.split("p_name", " ")))
    bridge = part.select(F.col("p_brand").alias("entity"), "skill").distinct()
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    counts = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("skill").agg(F.sum("n").alias("n"))
    return counts.join(bridge, "skill").groupBy("entity").agg(F.sum("n").cast("long").alias("n"))


@query("""WITH i AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey), q AS (SELECT * FROM i WHERE c % 100 = 0)
SELECT q.c AS customer, i.c AS other, count(*) AS shared, row_number() OVER (PARTITION BY q.c ORDER BY count(*) DESC, i.c) AS rank FROM q JOIN i ON q.p = i.p AND q.c <> i.c GROUP BY q.c, i.c QUALIFY rank <= 5""")
def profile_overlap_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every customer whose id is divisible by 100 the five with the most parts in common."""
    bought = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    left = bought.where("o_custkey % 100 = 0").select(F.col("o_custkey").alias("customer"), F.col("l_partkey").alias("p"))
    right = bought.select(F.col("o_custkey").alias("other"), F.col("l_partkey").alias("p"))
    shared = left.distinct().join(right.distinct(), "p").where("customer <> other").groupBy("customer", "other").agg(F.count("*").alias("shared"))
    w = Window.partitionBy("customer").orderBy(F.desc("shared"), "other")
    return shared.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5")


@query("""WITH s AS (SELECT DISTINCT p_brand AS entity, unnest(string_split(p_name, ' ')) AS skill FROM part), x AS (SELECT a.entity AS entity, b.entity AS other, count(*) AS shared FROM s a JOIN s b ON a.skill = b.skill GROUP BY 1, 2)
SELECT entity, other, shared, row_number() OVER (PARTITION BY entity ORDER BY shared DESC, other) AS rank FROM x QUALIFY rank <= 5""")
def skill_overlap_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five entities that share the most skills with each."""
    skills = table(spark, sf_dir, "part").select(F.col("p_brand").alias("entity"), F.explode(F.split("p_name", " ")).alias("skill"))
    return overlap_ranking(skills, skills.withColumnRenamed("entity", "other"), "entity", "other", "skill", 5)


@query(f"""WITH {OBS_SQL}, c AS (SELECT entity, family, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS f FROM obs GROUP BY ALL) SELECT entity, family, n FROM c QUALIFY row_number() OVER (PARTITION BY entity ORDER BY n DESC, f, family) = 1""")
def mode_first_seen_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent label, of equal ones the first seen."""
    rows = observations(spark, sf_dir).withColumn("place", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return mode_first_seen(rows, ["entity"], "family", "place")


@query(f"WITH {OBS_SQL}, c AS (SELECT entity, market, count(*) AS n FROM obs GROUP BY ALL) SELECT entity, count(*) AS markets, round(max(n) / min(n), 1) AS skew FROM c GROUP BY 1")
def skew_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets of each entity and the ratio of its largest to its smallest."""
    cells = observations(spark, sf_dir).groupBy("entity", "market").agg(F.count("*").alias("n"))
    return cells.groupBy("entity").agg(F.count("*").alias("markets"), F.round(F.max("n") / F.min("n"), 1).alias("skew"))


YEARLY_SQL = f"{OBS_SQL}, y AS (SELECT entity, market, yr, count(*) AS demand, median(unit_price) AS pay FROM obs GROUP BY ALL)"


def _yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return medians(observations(spark, sf_dir), ["entity", "market", "yr"], {"pay": F.col("unit_price")}, [F.count("*").alias("demand")], line_bound(spark, sf_dir))


@query(f"WITH {YEARLY_SQL} SELECT a.entity, a.market, round((b.pay - a.pay) / nullif(a.pay, 0) * 100, 1) AS pay_delta, round((b.demand - a.demand) / nullif(a.demand * 1.0E0, 0) * 100, 1) AS demand_delta FROM y a JOIN y b ON a.entity = b.entity AND a.market = b.market WHERE a.yr = 1996 AND b.yr = {LAST}")
def then_vs_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change in per cent between two years; one pass instead of a self-join."""
    year = F.col("yr")
    both = _yearly(spark, sf_dir).where(year.isin(1996, LAST)).groupBy("entity", "market").agg(*[F.max(F.when(year == y, F.col(c))).alias(f"{c}{k}") for k, y in ((0, 1996), (1, LAST)) for c in ("pay", "demand")]).where("pay0 is not null and pay1 is not null")
    return both.select("entity", "market", per_cent_change(F.col("pay1"), F.col("pay0")).alias("pay_delta"), per_cent_change(F.col("demand1"), F.col("demand0").cast("double")).alias("demand_delta"))


@query(f"""WITH {YEARLY_SQL}, m AS (SELECT market, yr, sum(demand) AS demand, avg(pay) AS pay FROM y GROUP BY ALL) SELECT a.market, b.market AS mirror, round(a.pay / b.pay, 4) AS pay_ratio, CAST(a.demand - b.demand AS bigint) AS demand_gap FROM m a JOIN m b ON a.yr = b.yr AND a.market < b.market WHERE a.yr = {LAST}""")
def market_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets side by side in one year; a row for each two of the few markets."""
    m = _yearly(spark, sf_dir).where(F.col("yr") == LAST).groupBy("market", "yr").agg(F.sum("demand").alias("demand"), F.avg("pay").alias("pay"))
    other = m.select(F.col("market").alias("mirror"), "yr", F.col("demand").alias("d"), F.col("pay").alias("p"))
    return m.join(other, "yr").where("market < mirror").select("market", "mirror", F.round(F.col("pay") / F.col("p"), 4).alias("pay_ratio"), (F.col("demand") - F.col("d")).cast("long").alias("demand_gap"))


@query(f"""WITH {YEARLY_SQL}, e AS (SELECT entity FROM y GROUP BY 1 ORDER BY sum(demand) DESC, entity LIMIT 4), m AS (SELECT market FROM y GROUP BY 1 ORDER BY sum(demand) DESC, market LIMIT 4) SELECT entity, market, demand, round(pay, 4) AS pay FROM y WHERE yr = {LAST} AND entity IN (SELECT entity FROM e) AND market IN (SELECT market FROM m)""")
def compare_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the four largest entities and markets; missing ones have no row."""
    y = _yearly(spark, sf_dir)
    top = lambda c: y.groupBy(c).agg(F.sum("demand").alias("_d")).orderBy(F.desc("_d"), c).limit(4).select(c)
    return y.where(F.col("yr") == LAST).join(F.broadcast(top("entity")), "entity", "left_semi").join(F.broadcast(top("market")), "market", "left_semi").select("entity", "market", "demand", F.round("pay", 4).alias("pay"))


@query(f"""WITH {OBS_SQL}, a AS (SELECT family, median(unit_price) AS pay, count(*) * 1.0E0 AS demand, count(DISTINCT market) * 1.0E0 AS reach, avg(p_size) AS level, avg(CASE WHEN l_returnflag = 'R' THEN 1.0E0 ELSE 0 END) AS churn, stddev_pop(unit_price) AS spread FROM obs GROUP BY 1)
SELECT family, round(pay / max(pay) OVER () * 100, 2) AS pay, round(demand / max(demand) OVER () * 100, 2) AS demand, round(reach / max(reach) OVER () * 100, 2) AS reach, round(level / max(level) OVER () * 100, 2) AS level, round(churn / max(churn) OVER () * 100, 2) AS churn, round(spread / max(spread) OVER () * 100, 2) AS spread FROM a""")
def role_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six axes of each family, each as a share of the largest."""
    others = [F.count("*").cast("double").alias("demand"), F.count_distinct("market").cast("double").alias("reach"), F.avg("p_size").alias("level"), F.avg((F.col("l_returnflag") == "R").cast("double")).alias("churn"), F.stddev_pop("unit_price").alias("spread")]
    axes = medians(observations(spark, sf_dir), ["family"], {"pay": F.col("unit_price")}, others, line_bound(spark, sf_dir))
    names = ("pay", "demand", "reach", "level", "churn", "spread")
    tops = axes.agg(*[F.max(c).alias(f"m_{c}") for c in names])
    return axes.join(F.broadcast(tops), F.lit(True)).select("family", *[F.round(F.col(c) / F.col(f"m_{c}") * 100, 2).alias(c) for c in names])


@query(f"""WITH {YEARLY_SQL}, s AS (SELECT entity, market, list(demand ORDER BY yr) AS d FROM y GROUP BY ALL) SELECT entity, market, round(CASE WHEN d[least(1, len(d))] = 0 THEN 0 ELSE d[least(6, len(d))] / d[least(1, len(d))] - 1 END, 4) AS growth FROM s""")
def series_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth between two places of a series, each the nearest that exists."""
    series = _yearly(spark, sf_dir).groupBy("entity", "market").agg(F.transform(F.sort_array(F.collect_list(F.struct("yr", "demand"))), lambda x: x["demand"].cast("double")).alias("d"))
    from marlstone.functions.score import at_clamped

    return series.select("entity", "market", F.round(growth(at_clamped(F.col("d"), 0), at_clamped(F.col("d"), 5)), 4).alias("growth"))


@query(f"WITH {YEARLY_SQL}, r AS (SELECT entity, market, max(pay) FILTER (yr = {LAST}) / nullif(max(pay) FILTER (yr = 1996), 0) AS g FROM y GROUP BY ALL) SELECT entity, round(max(g) - min(g), 4) AS spread, max(g) - min(g) > 0.18 AS diverges FROM r GROUP BY 1")
def growth_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an entity's growth differs much between markets."""
    year = F.col("yr")
    r = _yearly(spark, sf_dir).groupBy("entity", "market").agg((F.max(F.when(year == LAST, F.col("pay"))) / F.nullif(F.max(F.when(year == 1996, F.col("pay"))), F.lit(0.0))).alias("g"))
    spread = F.max("g") - F.min("g")
    return r.groupBy("entity").agg(F.round(spread, 4).alias("spread"), (spread > 0.18).alias("diverges"))


@query(f"WITH {YEARLY_SQL} SELECT entity, market, yr, round(demand / max(demand) OVER (PARTITION BY entity, market) * 100, 4) AS peak_index FROM y")
def peak_indexed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point as a share of its series' peak."""
    y = _yearly(spark, sf_dir)
    return y.select("entity", "market", "yr", F.round(F.col("demand") / F.max("demand").over(Window.partitionBy("entity", "market")) * 100, 4).alias("peak_index"))


@query(f"""WITH {OBS_SQL}, f AS (SELECT market, yr, avg(unit_price) AS a, avg(CASE WHEN l_returnflag <> 'N' THEN 1.0E0 ELSE 0 END) AS d FROM obs GROUP BY ALL), g AS (SELECT yr, avg(unit_price) AS a FROM obs GROUP BY 1) SELECT market, yr, round(f.a / g.a, 6) AS ppp, round(f.d, 4) AS disclosure FROM f JOIN g USING (yr)""")
def market_averages(spark: SparkSession, sf_dir: str, digits: int = 6) -> DataFrame:
    """Purchasing power and disclosure by market and year; the year's mean comes from the markets' sums."""
    m = observations(spark, sf_dir).groupBy("market", "yr").agg(F.sum("unit_price").alias("s"), F.count("*").alias("c"), F.avg((F.col("l_returnflag") != "N").cast("double")).alias("d"))
    w = Window.partitionBy("yr")
    return m.select("market", "yr", F.round((F.col("s") / F.col("c")) / (F.sum("s").over(w) / F.sum("c").over(w)), digits).alias("ppp"), F.round("d", 4).alias("disclosure"))


@query(f"""WITH {YEARLY_SQL}, m AS (SELECT market, sum(demand) AS demand, avg(pay) AS pay FROM y WHERE yr = {LAST} GROUP BY 1), u AS (SELECT 'demand' AS metric, market, demand * 1.0E0 AS value FROM m UNION ALL SELECT 'pay', market, pay FROM m)
SELECT metric, market, round(value, 4) AS value, row_number() OVER (PARTITION BY metric ORDER BY round(value, 6) DESC, market) AS rank FROM u""")
def country_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets by several metrics."""
    m = _yearly(spark, sf_dir).where(F.col("yr") == LAST).groupBy("market").agg(F.sum("demand").cast("double").alias("demand"), F.avg("pay").alias("pay"))
    u = m.select("market", F.explode(F.create_map(F.lit("demand"), "demand", F.lit("pay"), "pay")).alias("metric", "value"))
    w = Window.partitionBy("metric").orderBy(F.desc(F.round("value", 6)), "market")
    return u.select("metric", "market", F.round("value", 4).alias("value"), F.row_number().over(w).cast("long").alias("rank"))


@query(f"""WITH {YEARLY_SQL}, m AS (SELECT market, avg(pay) AS pay FROM y WHERE yr = {LAST} GROUP BY 1), f AS (SELECT market, avg(unit_price) AS a FROM obs WHERE yr = {LAST} GROUP BY 1), g AS (SELECT avg(unit_price) AS a FROM obs WHERE yr = {LAST}),
u AS (SELECT market, false AS parity, pay FROM m UNION ALL SELECT market, true, pay / (f.a / g.a) FROM m JOIN f USING (market) CROSS JOIN g)
SELECT market, parity, round(pay, 4) AS pay, row_number() OVER (PARTITION BY parity ORDER BY round(pay, 6) DESC, market) AS rank FROM u""")
def pay_ranking_with_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets by pay, as it is and at equal purchasing power."""
    pay = _yearly(spark, sf_dir).where(F.col("yr") == LAST).groupBy("market").agg(F.avg("pay").alias("pay"))
    parity = market_averages(spark, sf_dir, digits=12).where(F.col("yr") == LAST).select("market", "ppp")
    both = pay.join(parity, "market").select("market", F.explode(F.create_map(F.lit(False), F.col("pay"), F.lit(True), F.col("pay") / F.col("ppp"))).alias("parity", "pay"))
    w = Window.partitionBy("parity").orderBy(F.desc(F.round("pay", 6)), "market")
    return both.select("market", "parity", F.round("pay", 4).alias("pay"), F.row_number().over(w).cast("long").alias("rank"))


@query(f"WITH {YEARLY_SQL}, t AS (SELECT entity, sum(demand) AS n FROM y GROUP BY 1 ORDER BY n DESC, entity LIMIT 8) SELECT entity, CAST(n AS bigint) AS n FROM t")
def board_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board's eight largest; the limit is the feature."""
    return _yearly(spark, sf_dir).groupBy("entity").agg(F.sum("demand").cast("long").alias("n")).orderBy(F.desc("n"), "entity").limit(8)


@query(f"""WITH {YEARLY_SQL} SELECT entity, market, string_agg(yr || ':' || demand, ',' ORDER BY yr) AS series, count(*) AS points, arg_max(demand, yr) AS latest FROM y GROUP BY ALL""")
def nested_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell's series as one nested value, written as text."""
    points = F.sort_array(F.collect_list(F.struct("yr", "demand")))
    s = _yearly(spark, sf_dir).groupBy("entity", "market").agg(points.alias("p"))
    return s.select("entity", "market", F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["yr"], x["demand"])), ",").alias("series"), F.size("p").cast("long").alias("points"), F.element_at("p", -1)["demand"].alias("latest"))


@query(f"""WITH {OBS_SQL} SELECT 'rows' AS name, 'floor' AS category, CASE WHEN count(*) >= 1000 THEN 'pass' ELSE 'fail' END AS status, count(*) AS detail FROM obs
UNION ALL SELECT 'null_prices', 'contract', CASE WHEN count(*) FILTER (unit_price IS NULL) = 0 THEN 'pass' ELSE 'fail' END, count(*) FILTER (unit_price IS NULL) FROM obs
UNION ALL SELECT 'small_cells', 'suppression', CASE WHEN count(*) = 0 THEN 'pass' ELSE 'warn' END, count(*) FROM (SELECT 1 FROM obs GROUP BY entity, market, yr HAVING count(*) < 5)
UNION ALL SELECT 'volume', 'floor', CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END, count(*) FROM (SELECT entity FROM (SELECT entity, market, count(*) AS n FROM obs GROUP BY ALL) GROUP BY entity HAVING max(n) < 20)
UNION ALL SELECT 'disclosure', 'rate', CASE WHEN avg(CASE WHEN l_returnflag <> 'N' THEN 1.0E0 ELSE 0 END) >= 0.3 THEN 'pass' ELSE 'fail' END, CAST(round(avg(CASE WHEN l_returnflag <> 'N' THEN 100.0E0 ELSE 0 END)) AS bigint) FROM obs""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row floors, contracts, suppression and rates, a row for each check, from one aggregate of the facts."""
    cells = observations(spark, sf_dir).groupBy("entity", "market", "yr").agg(F.count("*").alias("n"), F.count(F.when(F.col("unit_price").isNull(), 1)).alias("nulls"), F.count(F.when(F.col("l_returnflag") != "N", 1)).alias("disclosed"))
    by_market = cells.groupBy("entity", "market").agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.sum("disclosed").alias("disclosed"), F.count(F.when(F.col("n") < 5, 1)).alias("small"))
    by_entity = by_market.groupBy("entity").agg(F.max("n").alias("most"), *[F.sum(c).alias(c) for c in ("n", "nulls", "disclosed", "small")])
    one = by_entity.agg(*[F.sum(c).cast("long").alias(c) for c in ("n", "nulls", "disclosed", "small")], F.count(F.when(F.col("most") < 20, 1)).alias("thin"))
    check = lambda name, category, ok, bad, detail: F.struct(F.lit(name).alias("name"), F.lit(category).alias("category"), F.when(F.expr(ok), "pass").otherwise(bad).alias("status"), F.expr(detail).cast("long").alias("detail"))
    checks = F.array(
        check("rows", "floor", "n >= 1000", "fail", "n"), check("null_prices", "contract", "nulls = 0", "fail", "nulls"), check("small_cells", "suppression", "small = 0", "warn", "small"), check("volume", "floor", "thin = 0", "fail", "thin"), check("disclosure", "rate", "disclosed / n >= 0.3", "fail", "round(disclosed * 100.0D / n)")
    )
    return one.select(F.inline(checks))


@query("""WITH cells AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, CASE WHEN count(*) >= 6 THEN avg(c_acctbal) END AS pay FROM customer GROUP BY ALL), m AS (SELECT o_orderstatus AS s, median(o_totalprice) AS m FROM orders WHERE o_totalprice > 0 GROUP BY 1), a AS (SELECT o_orderstatus AS s, max(o_totalprice) AS a FROM orders GROUP BY 1)
SELECT 'floor.orders' AS name, 'floor' AS category, CASE WHEN count(*) >= 1000 THEN 'pass' ELSE 'fail' END AS status, count(*) || ' rows, floor 1000' AS detail FROM orders
UNION ALL SELECT 'floor.absent', 'floor', 'fail', 'absent, floor 5' UNION ALL SELECT 'floor.optional', 'floor', 'skip', 'absent, optional' UNION ALL SELECT 'contract.part', 'contract', 'fail', 'missing p_wage'
UNION ALL SELECT 'contract.orders', 'contract', CASE WHEN count(*) FILTER (o_custkey IS NULL) = 0 AND count(*) FILTER (o_orderdate IS NULL) = 0 THEN 'pass' ELSE 'fail' END, 'held' FROM orders
UNION ALL SELECT 'suppression.cells', 'suppression', CASE WHEN count(*) FILTER (pay IS NOT NULL AND n < 8) = 0 THEN 'pass' ELSE 'fail' END, count(*) FILTER (pay IS NOT NULL AND n < 8) || ' thin rows with a value, floor 8' FROM cells
UNION ALL SELECT 'disclosure.customer', 'disclosure', CASE WHEN count(*) FILTER (c_acctbal > 0) >= 0.05E0 * count(*) THEN 'pass' ELSE 'fail' END, count(*) FILTER (c_acctbal > 0) || ' of ' || count(*) || ', least 0.05' FROM customer
UNION ALL SELECT 'volume.orders', 'volume', CASE WHEN count(*) FILTER (n < 3000) = 0 THEN 'pass' ELSE 'warn' END, count(*) FILTER (n < 3000) || ' below 3000' FROM (SELECT count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority)
UNION ALL SELECT 'sanity.orders', 'sanity', CASE WHEN count(*) FILTER (m NOT BETWEEN 0.2E0 * a AND 5.0E0 * a) = 0 THEN 'pass' ELSE 'fail' END, count(*) FILTER (m NOT BETWEEN 0.2E0 * a AND 5.0E0 * a) || ' of ' || count(*) || ' out of the band' FROM m JOIN a USING (s)""")
def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floors, contracts, suppression, disclosure, volume and bands as rows, by checks that are data."""
    orders, customer, part = (table(spark, sf_dir, t) for t in ("orders", "customer", "part"))
    cells = customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("pay")).withColumn("pay", F.when(F.col("n") >= 6, F.col("pay")))
    anchors = orders.groupBy("o_orderstatus").agg(F.max("o_totalprice").alias("anchor"))
    checks = [
        gate.RowFloor("orders", 1000), gate.RowFloor("absent", 5), gate.RowFloor("optional", 0), gate.Contract("part", ["p_partkey", "p_wage"]), gate.Contract("orders", ["o_orderkey", "o_custkey"], ["o_custkey", "o_orderdate"]),
        gate.Suppressed("cells", "pay", "n", 8), gate.Share("customer", "positive", "c_acctbal > 0", 0.05), gate.Volume("orders", "o_orderpriority", 3000), gate.Band("orders", "o_totalprice", "o_orderstatus", anchors),
    ]
    return gate.run_gate(spark, {"orders": orders, "customer": customer, "part": part, "cells": cells}, checks)


@query(f"""WITH {OBS_SQL} SELECT market, count(*) AS n, CAST(round(avg(unit_price)) AS bigint) AS avg_price FROM obs GROUP BY 1 ORDER BY 2 DESC, 1""")
def console_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free SQL over a named view, with ordinals."""
    observations(spark, sf_dir).createOrReplaceTempView("spine")
    return spark.sql("SELECT market, count(*) AS n, CAST(round(avg(unit_price)) AS bigint) AS avg_price FROM spine GROUP BY 1 ORDER BY 2 DESC, 1")


@query(f"WITH {OBS_SQL}, c AS (SELECT market, entity, median(unit_price) AS v FROM obs GROUP BY ALL) SELECT market, entity, floor(v / CASE WHEN v > 2000 THEN 50.0E0 ELSE 10.0E0 END + 0.5) * CASE WHEN v > 2000 THEN 50.0E0 ELSE 10.0E0 END AS nice FROM c")
def nice_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values to a readable step, by their size."""
    cells = medians(observations(spark, sf_dir), ["market", "entity"], {"v": F.col("unit_price")}, bound=line_bound(spark, sf_dir))
    return cells.select("market", "entity", nice(F.col("v"), F.when(F.col("v") > 2000, 50.0).otherwise(10.0)).alias("nice"))


@query("""WITH s AS (SELECT p_type AS family, unnest(string_split(p_name, ' ')) AS skill, p_retailprice AS price FROM part), f AS (SELECT skill, count(*) AS n, avg(price) AS p FROM s GROUP BY 1), o AS (SELECT DISTINCT skill FROM s WHERE family = (SELECT min(p_type) FROM part) AND price > 1500)
SELECT skill, n, round(p, 4) AS price FROM f WHERE skill NOT IN (SELECT skill FROM o) ORDER BY round(p, 4) DESC, skill LIMIT 4""")
def learn_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best paid skills that a profile doesn't have; the limit is the feature."""
    part = table(spark, sf_dir, "part")
    skills = part.select(F.col("p_type").alias("family"), F.explode(F.split("p_name", " ")).alias("skill"), F.col("p_retailprice").alias("price"))
    first = part.agg(F.min("p_type").alias("family"))
    owned = skills.where("price > 1500").join(F.broadcast(first), "family", "left_semi").select("skill").distinct()
    paid = skills.groupBy("skill").agg(F.count("*").alias("n"), F.round(F.avg("price"), 4).alias("price"))
    return paid.join(owned, "skill", "left_anti").orderBy(F.desc("price"), "skill").limit(4)


@query("""WITH c AS (SELECT p_type AS family, p_brand AS entity, avg(p_retailprice) AS x, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n DESC, entity) - 1 AS i FROM c)
SELECT family, round(sum(x / (i + 1.4E0)) / sum(1 / (i + 1.4E0)) * (0.82E0 + least(0.4E0, 0.05E0 * 4)), 4) AS value FROM r WHERE i < 5 GROUP BY 1""")
def weighted_profile_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blend of ranked matches, with falling weights."""
    cells = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("family"), F.col("p_brand").alias("entity")).agg(F.avg("p_retailprice").alias("x"), F.count("*").alias("n"))
    w = Window.partitionBy("family").orderBy(F.desc("n"), "entity")
    ranked = cells.withColumn("i", F.row_number().over(w) - 1).where("i < 5").withColumn("w", 1 / (F.col("i") + 1.4))
    return ranked.groupBy("family").agg(F.round(F.sum(F.col("x") * F.col("w")) / F.sum("w") * (0.82 + min(0.4, 0.05 * 4)), 4).alias("value"))


@query(f"""WITH {OBS_SQL}, m AS (SELECT market, month, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0E0 ELSE 0 END), 4) AS share FROM obs GROUP BY ALL) SELECT * FROM m""")
def flag_share_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag's share by month."""
    return observations(spark, sf_dir).groupBy("market", "month").agg(F.round(F.avg((F.col("l_returnflag") == "R").cast("double")), 4).alias("share"))


@query(f"WITH {OBS_SQL}, m AS (SELECT entity, month, count(*) AS n FROM obs GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY month DESC) AS r FROM m) SELECT entity, round(avg(n), 4) AS interest, count(*) AS points FROM r WHERE r <= 52 GROUP BY 1")
def last_52_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of each series' last 52 points."""
    months = observations(spark, sf_dir).groupBy("entity", "month").agg(F.count("*").alias("n"))
    w = Window.partitionBy("entity").orderBy(F.desc("month"))
    return months.withColumn("r", F.row_number().over(w)).where("r <= 52").groupBy("entity").agg(F.round(F.avg("n"), 4).alias("interest"), F.count("*").alias("points"))


@query(f"""WITH {OBS_SQL}, k AS (SELECT DISTINCT entity, market FROM obs WHERE yr = 1995 UNION SELECT DISTINCT entity, market FROM obs WHERE yr = 2001) SELECT entity, count(*) AS markets FROM k GROUP BY 1""")
def key_set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that one of two sets holds."""
    obs = observations(spark, sf_dir).select("entity", "market", "yr")
    return obs.where("yr = 1995").select("entity", "market").union(obs.where("yr = 2001").select("entity", "market")).distinct().groupBy("entity").agg(F.count("*").alias("markets"))


@query("SELECT n_name AS market, coalesce(s.n, 0) AS suppliers, CASE WHEN s.n IS NULL THEN 'stable' ELSE 'known' END AS trend FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 9000 GROUP BY 1) s ON n_nationkey = s_nationkey")
def dimension_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup with defaults for what is missing."""
    counts = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    joined = table(spark, sf_dir, "nation").join(counts, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return joined.select(F.col("n_name").alias("market"), F.coalesce("n", F.lit(0).cast("long")).alias("suppliers"), F.when(F.col("n").isNull(), "stable").otherwise("known").alias("trend"))


@query("""WITH e AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey), x AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM e JOIN customer ON c = c_custkey JOIN supplier ON s = s_suppkey WHERE c_nationkey <> s_nationkey)
SELECT a.n_name AS from_market, b.n_name AS to_market FROM x JOIN nation a ON x.a = a.n_nationkey JOIN nation b ON x.b = b.n_nationkey""")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between markets: both ends looked up, no loops, none twice."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    ends = lines.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = ends.select("c_nationkey", "s_nationkey").where("c_nationkey <> s_nationkey").distinct()
    side = lambda c: table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias(c), F.col("n_name").alias(f"name_{c}"))
    return edges.join(side("c_nationkey"), "c_nationkey").join(side("s_nationkey"), "s_nationkey").select(F.col("name_c_nationkey").alias("from_market"), F.col("name_s_nationkey").alias("to_market"))


@query(f"""WITH {YEARLY_SQL}, l AS (SELECT entity, market, max(yr) AS last FROM y GROUP BY ALL), n AS (SELECT y.entity, y.market, round(avg(pay), 6) AS fresh FROM y WHERE yr >= 1999 GROUP BY ALL)
SELECT y.entity, y.market, y.yr, round(CASE WHEN y.yr = l.last THEN n.fresh ELSE y.pay * n.fresh / p.pay END, 4) AS pay FROM y JOIN l USING (entity, market) JOIN n USING (entity, market) JOIN y p ON p.entity = y.entity AND p.market = y.market AND p.yr = l.last""")
def series_reanchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series scaled so that their last point is a newer value."""
    w = Window.partitionBy("entity", "market")
    y = _yearly(spark, sf_dir).withColumn("last", F.max("yr").over(w)).withColumn("fresh", F.round(F.avg(F.when(F.col("yr") >= 1999, F.col("pay"))).over(w), 6))
    y = y.withColumn("end", F.max(F.when(F.col("yr") == F.col("last"), F.col("pay"))).over(w)).where("fresh is not null")
    return y.select("entity", "market", "yr", F.round(F.when(F.col("yr") == F.col("last"), F.col("fresh")).otherwise(F.col("pay") * F.col("fresh") / F.col("end")), 4).alias("pay"))


@query(f"""WITH {OBS_SQL}, s AS (SELECT entity, market, count(*) AS n FROM obs WHERE yr = {LAST} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY n DESC, entity) AS rank, count(*) OVER (PARTITION BY market) AS k FROM s)
SELECT entity, market, rank, CAST(greatest(1, floor(rank * 100.0E0 / k + 0.5)) AS bigint) AS pctile FROM r""")
def seed_rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank and percentile, halves up."""
    from marlstone.functions.score import half_up

    s = observations(spark, sf_dir).where(F.col("yr") == LAST).groupBy("entity", "market").agg(F.count("*").alias("n"))
    w = Window.partitionBy("market")
    s = s.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "entity")).cast("long")).withColumn("k", F.count("*").over(w))
    return s.select("entity", "market", "rank", F.greatest(F.lit(1), half_up(F.col("rank") * 100.0 / F.col("k"))).cast("long").alias("pctile"))


@query("""WITH s AS (SELECT p_brand AS a, p_type AS b, greatest(0.3E0, 1 - (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) * 0.05E0) AS sim FROM part) SELECT a, b, round(max(sim), 4) AS similarity FROM s GROUP BY ALL""")
def max_similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest similarity of each pair, by rank in its list."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    sim = F.greatest(F.lit(0.3), 1 - (F.row_number().over(w) - 1) * 0.05)
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("a"), F.col("p_type").alias("b"), sim.alias("sim")).groupBy("a", "b").agg(F.round(F.max("sim"), 4).alias("similarity"))


@query("""SELECT p_brand AS entity, p_type AS skill, round(coalesce(avg(CASE WHEN p_size <= 5 THEN p_size * 20.0E0 END), avg(CASE WHEN p_size <= 7 THEN p_size / 7.0E0 * 100 END), max(CASE WHEN p_size > 40 THEN 100 WHEN p_size > 20 THEN 88 ELSE 62 END) * 1.0E0), 4) AS importance FROM part GROUP BY ALL""")
def scaled_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of ratings on two scales, or the highest flag."""
    s = F.col("p_size")
    flag = F.max(F.when(s > 40, 100.0).when(s > 20, 88.0).otherwise(62.0))
    mean = F.coalesce(F.avg(F.when(s <= 5, s * 20.0)), F.avg(F.when(s <= 7, s / 7.0 * 100)), flag)
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("entity"), F.col("p_type").alias("skill")).agg(F.round(mean, 4).alias("importance"))


@query(f"""WITH {OBS_SQL}, c AS (SELECT entity, market, floor(median(unit_price) * 100) / 100 AS pay, CAST(floor(avg(p_size) / 10) AS int) AS level, count(*) AS n FROM obs GROUP BY ALL) SELECT level, count(*) AS n, round(avg(CASE WHEN pay BETWEEN 1500 AND 3500 THEN 1.0E0 ELSE 0 END), 4) AS consistent FROM c GROUP BY 1""")
def consistency_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of cells within the band that their level allows."""
    cells = medians(observations(spark, sf_dir), ["entity", "market"], {"pay": F.col("unit_price")}, [F.floor(F.avg("p_size") / 10).cast("int").alias("level")], line_bound(spark, sf_dir))
    cells = cells.withColumn("pay", F.floor(F.col("pay") * 100) / 100)
    return cells.groupBy("level").agg(F.count("*").alias("n"), F.round(F.avg(F.col("pay").between(1500, 3500).cast("double")), 4).alias("consistent"))
