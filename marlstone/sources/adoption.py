"""Record rules of package registries and of occupational outlooks, from landed answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The answers of the registries, and the ends of series names that tell a measure.
DAILY = "struct<downloads:array<struct<downloads:string,day:string>>>"
VERSIONS = "struct<version_downloads:array<struct<date:string,downloads:string>>,meta:struct<extra_downloads:array<struct<downloads:string>>>>"
SEARCH = "struct<data:array<struct<totalDownloads:string>>>"
GEM = "struct<downloads:string>"
COUNTED = "struct<response:struct<numFound:string>>"
GROWTH, OPENINGS = "06", "07"
#: Texts that stand for no number.
BLANK = ("", "-", "n/a", "na", "..", "*")


def _sum(values: Column) -> Column:
    return F.aggregate(F.coalesce(values, F.array().cast("array<string>")), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x.try_cast("long"), F.lit(0).cast("long")))


def package_downloads(answers: DataFrame) -> DataFrame:
    """(ecosystem, package, skill, period, downloads, country) of landed answers (ecosystem, package, skill, period, payload); period is 'YYYY-MM'.

    npm: the days of the answer; crates: the days of the period, or else what the answer says of all others; nuget, rubygems: the total
    so far; maven: versions, for want of counts, and only of packages named 'group:artifact'. Other ecosystems, answers that
    aren't JSON and counts that aren't positive have no row. The country is empty: these counts have none.
    """
    read = lambda schema: F.from_json("payload", schema)
    days = read(VERSIONS)
    own = F.filter(days["version_downloads"], lambda d: F.startswith(d["date"], F.col("period")))
    monthly = _sum(F.transform(own, lambda d: d["downloads"]))
    rest = _sum(F.transform(days["meta"]["extra_downloads"], lambda d: d["downloads"]))
    kind = F.col("ecosystem")
    count = (
        F.when(kind == "npm", _sum(F.transform(read(DAILY)["downloads"], lambda d: d["downloads"])))
        .when(kind == "crates", F.when(monthly > 0, monthly).otherwise(rest))
        .when(kind == "nuget", F.get(read(SEARCH)["data"], 0)["totalDownloads"].try_cast("long"))
        .when(kind == "rubygems", read(GEM)["downloads"].try_cast("long"))
        .when((kind == "maven") & F.contains("package", F.lit(":")), read(COUNTED)["response"]["numFound"].try_cast("long"))
    )
    return answers.select("ecosystem", "package", "skill", "period", count.alias("downloads"), F.lit("").alias("country")).where("downloads > 0")


def located_downloads(log: DataFrame, packages: DataFrame, countries: tuple[str, ...]) -> DataFrame:
    """(ecosystem, package, skill, period, downloads, country) of a log of downloads (package, country_code, ts), by month and country.

    packages: (package, skill). Rows of other packages and countries don't count; codes in lower case do.
    """
    code = F.upper("country_code")
    counts = log.where(code.isin(*countries)).groupBy("package", code.alias("country"), F.date_format("ts", "yyyy-MM").alias("period")).agg(F.count("*").alias("downloads"))
    named = counts.join(packages.select("package", "skill"), "package")
    return named.select(F.lit("pypi").alias("ecosystem"), "package", "skill", "period", "downloads", "country")


def plain_number(c: Column) -> Column:
    """A number like '12.3%' or '1,234'; null for what stands for none."""
    s = F.regexp_replace(F.btrim(c), "[,%]", "")
    return F.when(~F.lower(s).isin(*BLANK), s.try_cast("double"))


def outlook_series(series: DataFrame, names: DataFrame, country: str = "US", system: str = "SOC", horizon: str = "2023-2033") -> DataFrame:
    """(country, system, occ_code, horizon, growth_pct, openings_per_year, outlook_rating) of series (series_id, value), a row for each one of a known measure.

    The occupation is the first six digits, or two and four with a hyphen, of the series' name; its last two characters tell the measure. names: (code without hyphen, name).
    """
    raw = F.regexp_extract(F.btrim("series_id"), "([0-9]{2}-[0-9]{4}|[0-9]{6})", 1)
    bare, measure = F.replace(raw, F.lit("-"), F.lit("")), F.right(F.btrim("series_id"), F.lit(2))
    rows = series.select(bare.alias("code"), measure.alias("measure"), plain_number(F.col("value")).alias("value")).where(F.col("value").isNotNull() & (F.col("code") != "") & F.col("measure").isin(GROWTH, OPENINGS))
    of = lambda m, name: F.when(F.col("measure") == m, F.col("value")).alias(name)
    code = F.concat_ws("-", F.substring("code", 1, 2), F.substring("code", 3, 4)).alias("occ_code")
    found = rows.join(names.select("code", F.col("name").alias("outlook_rating")), "code", "left")
    return found.select(F.lit(country).alias("country"), F.lit(system).alias("system"), code, F.lit(horizon).alias("horizon"), of(GROWTH, "growth_pct"), of(OPENINGS, "openings_per_year"), "outlook_rating")
