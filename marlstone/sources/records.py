"""Record rules of landed sources: job boards and wage filings, as tables of one shape.

Boards are landed as one JSON answer for each board: a table of (slug, payload). Answers that
aren't JSON, and boards without postings, give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.postings import country_of, is_certified, is_technical, yearly_wage
from marlstone.functions.text import experience_of, experience_of_range, midpoint, ordered_rules, wage_band
from marlstone.operators.aggregate import with_pooled
from marlstone.operators.lookup import two_level

# The fields of each kind of board, and the headings of wage filings, the older ones last.
BOARD_A = "struct<jobs:array<struct<id:string,title:string,company_name:string,location:struct<name:string>,departments:array<struct<name:string>>,content:string,updated_at:string,first_published:string,absolute_url:string>>>"
BOARD_B = "array<struct<id:string,text:string,country:string,workplaceType:string,categories:struct<location:string,department:string,team:string>,descriptionPlain:string,salaryRange:struct<min:double,max:double,currency:string>,createdAt:string,hostedUrl:string>>"
BOARD_C = "struct<jobs:array<struct<id:string,title:string,location:string,isRemote:boolean,department:string,team:string,descriptionPlain:string,publishedAt:string,jobUrl:string,compensation:struct<scrapeableCompensation:array<struct<compensationRange:struct<minValue:double,maxValue:double,currencyCode:string>>>>>>>"
FILING_HEADINGS = {
    "status": ("CASE_STATUS",),
    "code": ("SOC_CODE", "SOC_CODE_1", "OCCUPATIONAL_CODE", "OES_SOC_CODE"),
    "low": ("WAGE_RATE_OF_PAY_FROM", "WAGE_RATE_OF_PAY_FROM_1", "WAGE_RATE_OF_PAY"),
    "high": ("WAGE_RATE_OF_PAY_TO", "WAGE_RATE_OF_PAY_TO_1"),
    "unit": ("WAGE_UNIT_OF_PAY", "WAGE_UNIT_OF_PAY_1", "PW_UNIT_OF_PAY"),
    "level": ("PW_WAGE_LEVEL", "PW_WAGE_LEVEL_1", "WAGE_LEVEL"),
}
# The headings of a survey of developers, the newest first; its countries; and roles by words of what people say they are, the first that fits.
SURVEY_HEADINGS = {"country": ("Country",), "pay": ("ConvertedCompYearly", "ConvertedComp", "ConvertedSalary", "Salary"), "kinds": ("DevType", "DeveloperType"), "years": ("YearsCodePro", "YearsCode", "YearsCodedJob")}
SURVEY_COUNTRIES = {
    "India": "IN", "United States of America": "US", "United States": "US", "United Kingdom of Great Britain and Northern Ireland": "GB", "United Kingdom": "GB", "Canada": "CA", "Australia": "AU", "Singapore": "SG", "Germany": "DE",
}
SURVEY_ROLES = (
    ("machine learning", "ml-eng"), ("data scientist", "data-sci"), ("scientist", "data-sci"), ("data engineer", "data-eng"), ("data or business analyst", "data-analyst"), ("analyst", "data-analyst"), ("engineering manager", "eng-mgr"),
    ("devops", "devops"), ("site reliability", "sre"), ("security", "security"), ("cloud", "cloud-arch"), ("mobile", "mobile"), ("front-end", "frontend"), ("back-end", "backend"), ("full-stack", "swe"), ("embedded", "swe"),
    ("designer", "ux"), ("product manager", "pm"), ("qa", "qa"), ("test", "qa"), ("developer", "swe"),
)


def _or(*c: Column | str) -> Column:
    """The first text that is neither null nor empty, else an empty one."""
    return F.coalesce(*[F.nullif(F.col(x) if isinstance(x, str) else x, F.lit("")) for x in c], F.lit(""))


def _markup_free(c: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " ")
    return F.btrim(F.replace(F.replace(bare, F.lit("&amp;"), F.lit("&")), F.lit("&nbsp;"), F.lit(" ")))


def _postings(jobs: DataFrame, source: str, **c: Column) -> DataFrame:
    none = F.lit(None)
    text = lambda name: F.coalesce(c[name], F.lit("")).alias(name)
    true_or_null = F.when(c["remote"], True)
    return jobs.select(
        F.lit(source).alias("source"), F.col("slug").alias("board_slug"), text("external_id"), F.btrim(text("title")).alias("title"), _or(c.get("company", none.cast("string")), "slug").alias("company"),
        text("location"), country_of(c["location"], c.get("hint")).alias("country"), true_or_null.alias("remote"), text("department"), text("description"),
        c.get("low", none.cast("double")).alias("salary_min"), c.get("high", none.cast("double")).alias("salary_max"), F.coalesce(c.get("currency", none.cast("string")), F.lit("")).alias("salary_currency"), text("posted_at"), text("url"),
    )


def greenhouse(boards: DataFrame) -> DataFrame:
    """Postings of boards with a ``jobs`` list and descriptions in markup."""
    jobs = boards.select("slug", F.explode(F.from_json("payload", BOARD_A)["jobs"]).alias("j"))
    j, place = F.col("j"), F.coalesce(F.col("j.location.name"), F.lit(""))
    return _postings(
        jobs, "greenhouse", external_id=j["id"], title=j["title"], company=j["company_name"], location=place, remote=F.lower(place).contains("remote"),
        department=F.get(j["departments"], 0)["name"], description=_markup_free(j["content"]), posted_at=_or(j["updated_at"], j["first_published"]), url=j["absolute_url"],
    )


def lever(boards: DataFrame) -> DataFrame:
    """Postings of boards that are a plain list, with a country code and a pay range."""
    jobs = boards.select("slug", F.explode(F.from_json("payload", BOARD_B)).alias("j"))
    j = F.col("j")
    return _postings(
        jobs, "lever", external_id=j["id"], title=j["text"], location=j["categories"]["location"], hint=j["country"], remote=F.lower(j["workplaceType"]) == "remote",
        department=_or(j["categories"]["department"], j["categories"]["team"]), description=j["descriptionPlain"], low=j["salaryRange"]["min"], high=j["salaryRange"]["max"],
        currency=j["salaryRange"]["currency"], posted_at=j["createdAt"], url=j["hostedUrl"],
    )


def ashby(boards: DataFrame) -> DataFrame:
    """Postings of boards with a ``jobs`` list and tiers of pay, of which the first with a bound counts."""
    jobs = boards.select("slug", F.explode(F.from_json("payload", BOARD_C)["jobs"]).alias("j"))
    j = F.col("j")
    ranges = F.transform(j["compensation"]["scrapeableCompensation"], lambda x: x["compensationRange"])
    pay = F.get(F.filter(ranges, lambda r: (F.coalesce(r["minValue"], F.lit(0)) != 0) | (F.coalesce(r["maxValue"], F.lit(0)) != 0)), 0)
    return _postings(
        jobs, "ashby", external_id=j["id"], title=j["title"], location=j["location"], remote=j["isRemote"], department=_or(j["department"], j["team"]), description=j["descriptionPlain"],
        low=pay["minValue"], high=pay["maxValue"], currency=pay["currencyCode"], posted_at=j["publishedAt"], url=j["jobUrl"],
    )


def technical_only(postings: DataFrame) -> DataFrame:
    return postings.where(is_technical(F.col("title"), F.col("description")))


def filings(landed: DataFrame, year: int | Column, least: float = 20_000.0, most: float = 1_000_000.0) -> DataFrame:
    """(code, year, band, wage): certified filings with a code and a yearly wage in range, by whichever headings the landed table has.

    Headings count without regard to case and outer blanks. A table without code, lower bound or unit gives no rows; without
    a status all rows count; band is null without a level. The wage is the middle of a band, the lower bound of one that is
    turned round, or the bound that is there.
    """
    there = {c.strip().upper(): c for c in landed.columns}
    first = lambda names: next((there[n] for n in names if n in there), None)
    at = {field: first(names) for field, names in FILING_HEADINGS.items()}
    col = lambda field: F.col(f"`{at[field]}`").cast("string") if at[field] else F.lit(None).cast("string")
    code = F.btrim(col("code"))
    rows = landed.where(is_certified(col("status")) if at["status"] else F.lit(True)).where(F.lit(all(at[f] for f in ("code", "low", "unit"))))
    year = year if isinstance(year, Column) else F.lit(year)
    # Bounds are named once: a filter on an expression that repeats them would repeat their parsing below the joins.
    band = F.array(F.struct(yearly_wage(col("low"), col("unit")).alias("low"), yearly_wage(col("high"), col("unit")).alias("high")))
    wage = F.get(F.filter(F.transform(band, lambda b: midpoint(b["low"], b["high"])), lambda w: w.between(least, most)), 0)
    rows = rows.select(F.regexp_replace(code, "^([0-9]{2})([0-9]{4})$", "$1-$2").alias("code"), year.cast("long").alias("year"), wage_band(col("level")).alias("band"), wage.alias("wage"))
    return rows.where("code <> '' and wage is not null")


def filing_cells(rows: DataFrame, roles: DataFrame, least: int = 5) -> DataFrame:
    """(role, year, band, median, n, confidence) of filings, by band and pooled; roles: (code, role), whole codes before their first seven characters."""
    named = two_level(rows, "code", roles, 7, "role").where("role is not null")
    cells = with_pooled(named, ["role", "year"], "band", [F.bround(F.median("wage")).alias("median"), F.count("*").alias("n")]).where(F.col("n") >= least)
    return cells.withColumn("confidence", F.when(F.col("n") >= 500, "high").when(F.col("n") >= 50, "med").otherwise("low"))


def survey_rows(people: DataFrame, year: Column, ranges: bool = False, countries: dict[str, str] = SURVEY_COUNTRIES, roles: tuple[tuple[str, str], ...] = SURVEY_ROLES, least: float = 1_000, most: float = 1_000_000) -> DataFrame:
    """(role, country, band, year, pay) of people (country, pay, kinds, years, all text): those of known countries and roles whose yearly pay is within bounds.

    ``ranges`` tells that years are ranges ('9 to 10 years'), as in the oldest answers, not numbers.
    """
    code = F.create_map(*[F.lit(x) for pair in countries.items() for x in pair])[F.btrim("country")]
    kinds = F.lower(F.coalesce("kinds", F.lit("")))
    role = ordered_rules([(kinds.contains(word), name) for word, name in roles])
    band = experience_of_range(F.col("years")) if ranges else experience_of(F.col("years"))
    rows = people.select(role.alias("role"), code.alias("country"), band.alias("band"), year.cast("long").alias("year"), F.btrim("pay").try_cast("double").alias("pay"))
    return rows.where(F.col("role").isNotNull() & F.col("country").isNotNull() & F.col("pay").between(least, most))


def survey_cells(rows: DataFrame, least: int = 5) -> DataFrame:
    """(role, country, year, band, median, n, confidence) of survey rows, by band and pooled."""
    cells = with_pooled(rows, ["role", "country", "year"], "band", [F.bround(F.median("pay")).alias("median"), F.count("*").alias("n")]).where(F.col("n") >= least)
    return cells.withColumn("confidence", F.when(F.col("n") >= 200, "high").when(F.col("n") >= 40, "med").otherwise("low"))
