"""Queries on postings: classes, countries, names of skills, wage filings, repeats, derived roles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import postings as p
from marlstone.operators.lookup import suggest
from marlstone.operators.postings import derived_roles, repeated_postings
from marlstone.operators.windows import numbered
from marlstone.plans.observations import OBS_SQL, observations
from marlstone.plans.registry import query
from marlstone.sources.adoption import located_downloads, package_downloads
from marlstone.sources.records import filing_cells, filings, survey_cells, survey_rows
from marlstone.sources.tables import table

# Fixed values of the queries below: what titles, descriptions, places and skills of rows begin with.
TITLES = ("Backend Engineer", "AI Trainer", "Registered Nurse", "Sales Engineer", "Brand Manager, Digital", "Product Manager", "Barista", "Technical Account Manager", "Operations Lead", "Data Platform Analyst", "Account Executive", "Head of Growth")
DESCRIPTIONS = ("We run Kubernetes", "Great team", "You will sell software", "", "Machine learning daily")
PLACES = ("Bengaluru, India", "Austin, TX", "Remote - US", "Toronto", "Paris, France", "Leeds / UK", "Portland | OR", "", "Cologne", "U.S. only", "Oregano, ORE", "New South Wales, Australia")
SKILLS = ("Node.js", "Amazon Web Services (AWS)", " PostgreSQL ", "(hidden)", "CI CD", "Go lang.", "k8s", "REST API", "MS  SQL", "Vector DBs,")


def _of(values: tuple[str, ...], key: str) -> Column:
    """The value at the place that the key's remainder gives."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def _of_sql(values: tuple[str, ...], key: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{key} % {len(values)} + 1]"


def _one_of(patterns: tuple[str, ...]) -> str:
    return "(?i)(" + ")|(".join(patterns) + ")"


@query(f"""WITH r AS (SELECT o_orderkey AS id, {_of_sql(TITLES, "o_orderkey")} || ' ' || lower(o_orderstatus) AS t, {_of_sql(DESCRIPTIONS, "o_custkey")} AS d FROM orders),
h AS (SELECT id, regexp_matches(t, '{_one_of(p.VETO_TITLES)}') AS v, regexp_matches(t, '{_one_of(p.STRONG_TITLES)}') AS s, regexp_matches(t, '{_one_of(p.NEGATIVE_TITLES)}') AS n, regexp_matches(t, '{_one_of(p.SOFT_TITLES)}') AS w, regexp_matches(d, '{_one_of(p.STRONG_TITLES)}') AS ds FROM r)
SELECT id, NOT v AND (s OR (NOT n AND (w OR ds))) AS technical FROM h""")
def technical_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings by title and description: technical or not."""
    title = F.concat_ws(" ", _of(TITLES, "o_orderkey"), F.lower("o_orderstatus"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), p.is_technical(title, _of(DESCRIPTIONS, "o_custkey")).alias("technical"))


def _words_sql() -> str:
    return " ".join(f"WHEN regexp_matches(l, '\\b({'|'.join(map(re.escape, w))})\\b') THEN '{c}'" for c, w in p.COUNTRY_WORDS.items())


def _cities_sql() -> str:
    return " ".join("WHEN " + " OR ".join(f"contains(l, '{x}')" for x in cities) + f" THEN '{c}'" for c, cities in p.CITIES.items())


@query(f"""WITH r AS (SELECT c_custkey AS customer, lower(trim({_of_sql(PLACES, "c_custkey")})) AS l, CASE WHEN c_custkey % 7 = 0 THEN ' gb ' WHEN c_custkey % 7 = 1 THEN 'fr' END AS h FROM customer)
SELECT customer, CASE WHEN upper(trim(h)) IN ('IN', 'US', 'GB', 'CA', 'AU', 'SG', 'DE') THEN upper(trim(h)) {_words_sql()} {_cities_sql()} WHEN trim(list_extract(string_split_regex(l, '[,/|]'), -1)) IN ({", ".join(f"'{s}'" for s in p.US_STATES)}) THEN 'US' END AS country FROM r""")
def posting_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries of places, by hint, name, city and state."""
    key = F.col("c_custkey")
    hint = F.when(key % 7 == 0, " gb ").when(key % 7 == 1, "fr")
    return table(spark, sf_dir, "customer").select(key.alias("customer"), p.country_of(_of(PLACES, "c_custkey"), hint).alias("country"))


@query(f"""WITH r AS (SELECT l_orderkey AS id, l_linenumber AS line, lower(trim({_of_sql(SKILLS, "l_partkey")})) AS l FROM lineitem), b AS (SELECT id, line, coalesce(nullif(trim(string_split(l, '(')[1]), ''), l) AS b FROM r),
n AS (SELECT id, line, CASE b {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in p.SKILL_NAMES.items())} ELSE b END AS n FROM b)
SELECT id, line, trim(regexp_replace(CASE WHEN n = 'ci/cd' THEN 'ci / cd' ELSE n END, '\\s+', ' ', 'g'), ' .,-') AS skill FROM n""")
def skill_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of skills in their common form."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), p.skill_key(_of(SKILLS, "l_partkey")).alias("skill"))


UNITS = ("Year", "hr", "weekly", "Bi-Weekly", "piece", "mth")
LEVELS = ("I", "Level II", "3", "", "iv")


@query(f"""WITH f AS (SELECT CAST(year(l_shipdate) AS bigint) AS year, l_linestatus, l_returnflag, '15-' || (1200 + p_size) AS base, p_size, l_orderkey, {_of_sql(UNITS, "l_orderkey")} AS unit, {_of_sql(LEVELS, "l_partkey")} AS level,
  CAST(CAST(l_extendedprice AS decimal(12, 2)) AS double) AS lo, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(CAST(l_extendedprice * (1.05 - l_discount) AS decimal(12, 2)) AS double) END AS hi FROM lineitem JOIN part ON l_partkey = p_partkey),
w AS (SELECT *, CASE lower(unit) WHEN 'year' THEN 1 WHEN 'hr' THEN 2080 WHEN 'weekly' THEN 52 WHEN 'bi-weekly' THEN 26 WHEN 'mth' THEN 12 END AS k FROM f WHERE l_returnflag <> 'R'),
y AS (SELECT *, CASE WHEN k IS NOT NULL THEN lo * k WHEN lo >= 20000 THEN lo END AS a, CASE WHEN k IS NOT NULL THEN hi * k WHEN hi >= 20000 THEN hi END AS b FROM w),
m AS (SELECT *, CASE WHEN b >= a THEN (a + b) / 2 ELSE coalesce(a, b) END AS wage, CASE level WHEN 'I' THEN '0-2' WHEN 'Level II' THEN '3-5' WHEN '3' THEN '6-9' WHEN 'iv' THEN '10+' END AS band FROM y),
r AS (SELECT *, CASE WHEN p_size % 5 = 0 AND l_orderkey % 2 = 0 THEN 'special ' || p_size WHEN p_size % 3 <> 0 THEN 'role ' || p_size END AS role FROM m WHERE wage BETWEEN 20000 AND 1000000),
g AS (SELECT role, year, CASE WHEN grouping(band) = 1 THEN 'pooled' ELSE band END AS band, grouping(band) AS pooled, round_even(median(wage), 0) AS median, count(*) AS n FROM r WHERE role IS NOT NULL GROUP BY GROUPING SETS ((role, year, band), (role, year)) HAVING count(*) >= 5)
SELECT role, year, band, median, n, CASE WHEN n >= 500 THEN 'high' WHEN n >= 50 THEN 'med' ELSE 'low' END AS confidence FROM g WHERE pooled = 1 OR band IS NOT NULL""")
def filed_wages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wages of certified filings by role, year and band: order lines in the shape of filings."""
    part = table(spark, sf_dir, "part")
    lines = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    money = lambda c: c.cast("decimal(12,2)").cast("string")
    landed = lines.select(
        F.year("l_shipdate").alias("year"), F.when(F.col("l_returnflag") == "R", "Denied").when(F.col("l_returnflag") == "A", "CERTIFIED - Withdrawn").otherwise(" Certified ").alias("Case_Status"),
        F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("15-"), F.col("p_size") + 1200, F.lit(".01"))).otherwise(F.concat(F.lit("15"), F.col("p_size") + 1200)).alias(" SOC_CODE"),
        F.concat(F.lit("$"), money(F.col("l_extendedprice"))).alias("WAGE_RATE_OF_PAY"), F.when(F.col("l_linenumber") % 3 != 0, money(F.col("l_extendedprice") * (F.lit(1.05) - F.col("l_discount")))).alias("WAGE_RATE_OF_PAY_TO"),
        _of(UNITS, "l_orderkey").alias("PW_UNIT_OF_PAY"), _of(LEVELS, "l_partkey").alias("PW_WAGE_LEVEL"),
    )
    size, base = F.col("p_size"), F.concat(F.lit("15-"), F.col("p_size") + 1200)
    sizes = part.select("p_size").distinct()
    roles = sizes.where(size % 3 != 0).select(base.alias("code"), F.concat(F.lit("role "), size).alias("role")).unionByName(sizes.where(size % 5 == 0).select(F.concat(base, F.lit(".01")).alias("code"), F.concat(F.lit("special "), size).alias("role")))
    return filing_cells(filings(landed, F.col("year")), roles)


@query()
def repeated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one source and language whose texts repeat, by signatures of their shingles."""
    return repeated_postings(table(spark, sf_dir, "documents"), "doc_id", ["source", "lang"], "text")


@query("""WITH t AS (SELECT n_name AS market, CASE l_linenumber % 3 WHEN 0 THEN 'Senior ' WHEN 1 THEN 'Lead ' ELSE '' END || p_name || CASE WHEN l_linenumber % 2 = 0 THEN ' II' ELSE '' END AS title, p_name AS canon FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
c AS (SELECT market, canon, count(*) AS n, list_sort(list_distinct(list(title)))[1:50] AS titles FROM t GROUP BY ALL HAVING count(*) >= 20)
SELECT 'derived:' || lower(market) || ':' || regexp_replace(canon, ' ', '-', 'g') AS role_id, market, array_to_string(list_transform(string_split(canon, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS label_title, n AS posting_count, CAST(to_json(titles) AS varchar) AS member_titles FROM c""")
def roles_of_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles that at least twenty lines of a market name, whatever their level words."""
    line, part, supplier, nation = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation"))
    lines = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    n = F.col("l_linenumber")
    title = F.concat(F.when(n % 3 == 0, "Senior ").when(n % 3 == 1, "Lead ").otherwise(""), F.col("p_name"), F.when(n % 2 == 0, " II").otherwise(""))
    return derived_roles(lines.select(F.col("n_name").alias("market"), title.alias("title")), "market", "title", floor=20)


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS row_id FROM events")
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense numbers of events in the order of time."""
    return numbered(table(spark, sf_dir, "events").select("ts", "event_id"), ["ts", "event_id"]).select("event_id", "row_id")


@query("""WITH n AS (SELECT DISTINCT p_name AS id FROM part), q AS (SELECT substr(id, 1, 2) AS query FROM n UNION SELECT substr(string_split(id, ' ')[2], 1, 3) FROM n),
h AS (SELECT query, id, CASE WHEN starts_with(id, query) THEN 1.0E0 ELSE 0.9E0 END AS score FROM q JOIN n ON starts_with(id, query) OR contains(id, ' ' || query))
SELECT query, id, score, 'prefix' AS tier, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM h QUALIFY rank <= 8""")
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by the beginning of the whole or of a word; the eight best are the feature."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("alias"), F.col("p_name").alias("id")).distinct()
    asked = names.select(F.substring("id", 1, 2).alias("query")).union(names.select(F.substring(F.split("id", " ")[1], 1, 3)))
    return suggest(asked.distinct(), names)


RESUME = ("10 years of Python, SQL and Kubernetes", "React / TypeScript, GraphQL", "stakeholder mgmt, roadmapping", "nothing", "CI/CD on AWS with Docker, Linux, Terraform and networking", "javascript pythonic Go-to")


def _axis_sql(own: tuple[str, ...]) -> str:
    return f"CAST(least(30 + 16 * len(list_filter(s, lambda x: x IN ({', '.join(f'{chr(39)}{x}{chr(39)}' for x in own)}))), 98) AS bigint)"


KNOWN = sorted({s for own in p.AXES.values() for s in own})


@query(f"""WITH r AS (SELECT conv_id, turn, lower(text || ' ' || {_of_sql(RESUME, "(conv_id + turn)")}) AS l FROM conversations),
f AS (SELECT conv_id, turn, list_filter([{", ".join(f"CASE WHEN regexp_matches(l, '{chr(92)}b{re.escape(s.lower())}{chr(92)}b') THEN '{s}' END" for s in KNOWN)}], lambda x: x IS NOT NULL) AS f FROM r),
s AS (SELECT conv_id, turn, CASE WHEN len(f) > 0 THEN f ELSE ['SQL', 'Python'] END AS s FROM f)
SELECT conv_id, turn, array_to_string(s, ',') AS skills, {", ".join(f"{_axis_sql(own)} AS axis_{i}" for i, own in enumerate(p.AXES.values()))} FROM s""")
def resume_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills that a profile's text names, and its six axes."""
    place = F.element_at(F.array(*map(F.lit, RESUME)), ((F.col("conv_id") + F.col("turn")) % len(RESUME) + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", p.skills_named(F.concat_ws(" ", "text", place), KNOWN).alias("s"))
    axes = rows.withColumn("axes", p.axis_scores(F.col("s")))
    return axes.select("conv_id", "turn", F.array_join("s", ",").alias("skills"), *[F.col("axes")[axis].alias(f"axis_{i}") for i, axis in enumerate(p.AXES)])


KINDS = ("Developer, back-end;Student", "Data scientist or machine learning specialist", "Designer", "Engineering manager;Developer", "Marketer", "")
SURVEYED = ("India", "United States of America", "Narnia", "Canada", " Germany ")
YEARS = ("Less than 1 year", "4", "More than 50 years", "NA", "7.5", " 9 ")


@query(f"""WITH {OBS_SQL}, p AS (SELECT CASE CAST(substr(market, 8) AS int) % 5 WHEN 0 THEN 'IN' WHEN 1 THEN 'US' WHEN 3 THEN 'CA' WHEN 4 THEN 'DE' END AS country, CASE l_linenumber % 6 WHEN 0 THEN 'backend' WHEN 1 THEN 'ml-eng' WHEN 2 THEN 'ux' WHEN 3 THEN 'eng-mgr' END AS role,
CASE l_orderkey % 6 WHEN 0 THEN '0-2' WHEN 1 THEN '3-5' WHEN 2 THEN '10+' WHEN 4 THEN '6-9' WHEN 5 THEN '6-9' ELSE 'pooled' END AS band, yr AS year, unit_price AS pay FROM obs WHERE unit_price BETWEEN 1000 AND 1000000),
r AS (SELECT * FROM p WHERE country IS NOT NULL AND role IS NOT NULL), c AS (SELECT role, country, year, band, pay FROM r WHERE band <> 'pooled' UNION ALL SELECT role, country, year, 'pooled', pay FROM r)
SELECT role, country, year, band, round_even(median(pay), 0) AS median, count(*) AS n, CASE WHEN count(*) >= 200 THEN 'high' WHEN count(*) >= 40 THEN 'med' ELSE 'low' END AS confidence FROM c GROUP BY ALL HAVING count(*) >= 5""")
def surveyed_pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median pay by role, country, year and experience, of order lines as answers to a survey."""
    obs = observations(spark, sf_dir)
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    people = obs.select(pick(SURVEYED, F.substring("market", 8, 9).cast("int")).alias("country"), F.col("unit_price").cast("string").alias("pay"), pick(KINDS, F.col("l_linenumber")).alias("kinds"), pick(YEARS, F.col("l_orderkey")).alias("years"), "yr")
    return survey_cells(survey_rows(people, F.col("yr")))


@query("""WITH d AS (SELECT event_type AS package, strftime(ts, '%Y-%m') AS period, count(*) AS n FROM events GROUP BY ALL) SELECT e AS ecosystem, package, 'skill ' || package AS skill, period, n AS downloads, '' AS country FROM d, (SELECT unnest(['npm', 'crates', 'nuget', 'rubygems']) AS e)
UNION ALL SELECT 'maven', 'org:' || package, 'skill ' || package, period, n, '' FROM d""")
def registry_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly downloads by package, of events landed as the answers of five registries."""
    days = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("package"), F.date_format("ts", "yyyy-MM").alias("period"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("downloads"))
    months = days.groupBy("package", "period").agg(F.collect_list(F.struct("day", F.col("day").alias("date"), "downloads")).alias("days"), F.sum("downloads").alias("n"))
    answer = {
        "npm": F.struct(F.col("days").alias("downloads")), "crates": F.struct(F.col("days").alias("version_downloads")), "nuget": F.struct(F.array(F.struct(F.col("n").alias("totalDownloads"))).alias("data")),
        "rubygems": F.struct(F.col("n").alias("downloads")), "maven": F.struct(F.struct(F.col("n").alias("numFound")).alias("response")),
    }
    each = F.array(*[F.struct(F.lit(e).alias("ecosystem"), F.to_json(a).alias("payload")) for e, a in answer.items()])
    rows = months.select("package", "period", F.explode(each).alias("a")).select("a.ecosystem", F.concat(F.when(F.col("a.ecosystem") == "maven", "org:").otherwise(""), "package").alias("package"), F.concat(F.lit("skill "), "package").alias("skill"), "period", "a.payload")
    return package_downloads(rows)


@query("""SELECT 'pypi' AS ecosystem, event_type AS package, 'skill ' || event_type AS skill, strftime(ts, '%Y-%m') AS period, count(*) AS downloads, c AS country FROM (SELECT *, CASE user_id % 5 WHEN 0 THEN 'IN' WHEN 1 THEN 'US' WHEN 2 THEN 'DE' END AS c FROM events WHERE event_type <> 'view') WHERE c IS NOT NULL GROUP BY ALL""")
def downloads_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downloads of known packages by month and country, from a log."""
    user = F.col("user_id") % 5
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("package"), F.when(user == 0, "in").when(user == 1, "US").when(user == 2, "de").otherwise("FR").alias("country_code"), "ts")
    packages = table(spark, sf_dir, "events").select(F.col("event_type").alias("package")).distinct().where("package <> 'view'").withColumn("skill", F.concat(F.lit("skill "), "package"))
    return located_downloads(log, packages, ("IN", "US", "DE"))
