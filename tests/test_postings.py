"""Rules of postings and filings on literal cases; repeats against all pairs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions import postings as p
from marlstone.functions.text import shingles
from marlstone.operators.aggregate import counted_median
from marlstone.operators.lookup import suggest
from marlstone.operators.postings import derived_roles, repeated_postings, signatures
from marlstone.operators.windows import numbered
from marlstone.sources import records

TITLES = [
    ("Senior Software Engineer", "", True), ("AI Trainer", "software", False), ("Sales & Service Consultant", "python software", False), ("Registered Nurse", "uses software", False), ("Nurse", "", False),
    ("Technical Account Manager", "", True), ("Account Manager", "technical support", False), ("Account Manager", "", False), ("Process Engineer", "", True), ("Marketing Analyst", "", False),
    ("Mystery", "We deploy to kubernetes", True), ("Mystery", None, False), (None, None, False), ("", "software", True), ("Site Reliability Wizard", None, True), ("Brand Manager, Digital", "", False),
]


def test_technical(spark):
    df = spark.createDataFrame([(i, t, d) for i, (t, d, _) in enumerate(TITLES)], "i int, t string, d string")
    got = {r.i: r.x for r in df.select("i", p.is_technical(F.col("t"), F.col("d")).alias("x")).collect()}
    assert [got[i] for i in range(len(TITLES))] == [w for *_, w in TITLES]


@pytest.mark.parametrize(
    ("place", "hint", "want"),
    [
        ("Bengaluru", None, "IN"), ("Paris", "de", "DE"), ("Paris", "FR", None), ("San Francisco, CA", None, "US"), ("Portland / or", None, "US"), ("Indianapolis", None, None), ("", None, None), (None, " sg ", "SG"),
        ("Köln", None, "DE"), ("London, Canada", None, "CA"), ("Work in the U.K. office", None, None), ("uk remote", None, "GB"), ("Remote - US", None, "US"), ("Oregano, ORE", None, None),
    ],
)
def test_country(spark, place, hint, want):
    df = spark.createDataFrame([(place, hint)], "l string, h string")
    assert df.select(p.country_of(F.col("l"), F.col("h")).alias("x")).first().x == want
    if hint is None:
        assert df.select(p.country_of(F.col("l")).alias("x")).first().x == want


@pytest.mark.parametrize(("given", "want"), [("Node.js", "node"), ("Amazon Web Services (AWS)", "aws"), ("(only)", "(only)"), ("CI CD", "ci / cd"), (" Vector  DBs.,", "vector dbs"), (None, ""), ("Golang", "go")])
def test_skill_key(spark, given, want):
    assert spark.createDataFrame([(given,)], "c string").select(p.skill_key(F.col("c")).alias("x")).first().x == want


@pytest.mark.parametrize(
    ("low", "high", "unit", "want"),
    [
        ("$100,000", "120000", "Year", 110_000), ("50", None, "hr", 104_000), ("120000", "100000", "yr", 120_000), (None, "2000", " Bi-Weekly ", 52_000), ("60000", None, "piece", 60_000), ("50", None, "piece", None),
        ("5", "6", "year", None), ("-1", "x", "year", None), (None, None, None, None), ("2000000", None, "year", None),
    ],
)
def test_filing_wage(spark, low, high, unit, want):
    df = spark.createDataFrame([("certified", "c", low, high, unit)], "CASE_STATUS string, SOC_CODE string, WAGE_RATE_OF_PAY string, WAGE_RATE_OF_PAY_TO string, PW_UNIT_OF_PAY string")
    assert [r.wage for r in records.filings(df, 2024).collect()] == ([] if want is None else [want])


def test_filings(spark):
    columns = [" Case_Status", "soc_code", "WAGE_RATE_OF_PAY_FROM", "WAGE_UNIT_OF_PAY", "PW_WAGE_LEVEL"]
    data = [("Certified", "151252", "100000", "Year", "II")] * 5 + [("Denied", "15-1252", "1", "Year", "I"), (None, "15-1252", "90000", "Year", None), ("certified - withdrawn", "15-1252.09", "102001", "year", ""), ("Certified", "", "90000", "Year", "I")]
    rows = records.filings(spark.createDataFrame(data, columns), 2024)
    assert rows.count() == 6 and {r.code for r in rows.collect()} == {"15-1252", "15-1252.09"}
    roles = spark.createDataFrame([("15-1252", "dev")], "code string, role string")
    got = {r.band: (r["median"], r.n, r.confidence) for r in records.filing_cells(rows, roles).collect()}
    assert got == {"pooled": (100_000, 6, "low"), "3-5": (100_000, 5, "low")}
    assert records.filings(spark.createDataFrame([("x",)], "a string"), 2024).count() == 0


def test_boards(spark):
    def boards(payload):
        return spark.createDataFrame([("acme", json.dumps(payload)), ("gone", "not json"), ("none", None)], "slug string, payload string")

    a = records.greenhouse(boards({"jobs": [{"id": 7, "title": " Data Engineer ", "location": {"name": "Remote - US"}, "departments": [{"name": "Data"}], "content": "<p>a &amp; b</p>", "first_published": "2024"}, {"id": 8, "title": "Chef"}]}))
    row = a.where("external_id = '7'").first()
    assert (row.title, row.company, row.country, row.remote, row.department, row.description, row.posted_at) == ("Data Engineer", "acme", "US", True, "Data", "a & b", "2024")
    assert a.count() == 2 and [r.external_id for r in records.technical_only(a).collect()] == ["7"] and a.where("external_id = '8'").first().remote is None
    b = records.lever(boards([{"id": "x", "text": "SRE", "country": "de", "workplaceType": "Remote", "categories": {"location": "Anywhere", "team": "Ops"}, "salaryRange": {"min": 1, "max": 2.5, "currency": "EUR"}, "createdAt": 17}]))
    row = b.first()
    assert (row.country, row.remote, row.department, row.salary_min, row.salary_max, row.salary_currency, row.posted_at) == ("DE", True, "Ops", 1.0, 2.5, "EUR", "17")
    tiers = {"scrapeableCompensation": [{"compensationRange": None}, {"compensationRange": {"minValue": 0}}, {"compensationRange": {"minValue": 5, "maxValue": 9, "currencyCode": "GBP"}}]}
    c = records.ashby(boards({"jobs": [{"id": "y", "title": "QA", "location": "Leeds", "isRemote": False, "department": "", "team": "T", "compensation": tiers}]}))
    row = c.first()
    assert (row.country, row.remote, row.department, row.salary_min, row.salary_max, row.salary_currency) == ("GB", None, "T", 5.0, 9.0, "GBP")
    assert a.columns == b.columns == c.columns


def test_signatures_are_minima_of_seeded_hashes(spark, monkeypatch):
    """One hash for each run of words, that many registers; the work grows with a text's length."""
    monkeypatch.setattr("marlstone.operators.postings.AT_ONCE", 50)
    random.seed(8)
    texts = [" ".join(random.choices("abcdefgh", k=n)) for n in (1, 4, 5, 6, 40, 200)]
    df = spark.createDataFrame([*enumerate(texts), (3, "later row of three"), (9, None), (10, "Ünder, the-K+ 77.5 /x/ ..")], "id long, text string")
    got = {r.id: r.sig for r in signatures(df, "id", [], "text").collect()}
    runs = [(k, " ".join(w[i : i + 5])) for k, t in [*enumerate(texts), (3, "later row of three"), (10, "nder the k+ 77.5 /x/")] for w in [t.split()] for i in range(max(1, len(w) - 4))]
    minima = [F.min(F.xxhash64("s", F.lit(i))).alias(f"m{i}") for i in range(32)]
    want = {r.id: list(r)[1:] for r in spark.createDataFrame(runs, "id long, s string").groupBy("id").agg(*minima).collect()}
    assert got == {**want, 9: [0] * 32}
    plan = spark.createDataFrame([(["a"],)], "w array<string>").select(shingles(F.col("w")))._jdf.queryExecution().toString()
    assert "slice(" not in plan  # copies all words for each shingle


def test_repeated_postings(spark, monkeypatch):
    monkeypatch.setattr("marlstone.operators.postings.BLOCK", 7)
    random.seed(5)
    words = [f"w{i}" for i in range(400)]
    posts = []
    for base in range(12):
        text = random.choices(words, k=120)
        for copy in range(6):
            own = list(text)
            for _ in range(copy):
                own[random.randrange(120)] = random.choice(words)
            posts.append((len(posts), f"e{base % 2}" if base else None, " ".join(own), "extra"))
    posts += [(100, "e1", "", ""), (101, "e1", None, ""), (102, "e0", "", ""), (103, "e1", posts[6][2], ""), (104, "e1", posts[6][2], "")]
    df = spark.createDataFrame(posts, "id long, employer string, text string, _n string")
    sig = {r.id: (r.employer, r.sig) for r in signatures(df, "id", ["employer"], "text").collect()}
    group = {i: i for i in sig}
    for _ in range(len(group)):
        for i in sig:
            for j in sig:
                if sig[i][0] == sig[j][0] and sum(x == y for x, y in zip(sig[i][1], sig[j][1], strict=True)) >= 26:
                    group[i] = group[j] = min(group[i], group[j])
        if all(group[group[i]] == group[i] for i in group):
            break
    got = dict(map(tuple, repeated_postings(df, "id", ["employer"], "text").collect()))
    assert got == group and got[101] == 100 and got[102] == 102 and 1 < len(set(group.values())) < len(group) - 5
    assert repeated_postings(df.where("id < 0"), "id", ["employer"], "text").count() == 0


def test_derived_roles(spark):
    data = [("IN", "Senior Data Engineer")] * 3 + [("IN", "data engineer II")] * 2 + [("IN", "Rare")] + [("US", "Lead")] * 4 + [("US", None)] + [(None, "x")] * 9
    got = {r.role_id: tuple(r)[1:] for r in derived_roles(spark.createDataFrame(data, "m string, t string"), "m", "t", floor=5).collect()}
    assert got == {"derived:in:data-engineer": ("IN", "Data Engineer", 5, '["Senior Data Engineer","data engineer II"]'), "derived:us:role": ("US", "Role", 5, '["","Lead"]')}


def test_counted_median_and_numbers(spark):
    random.seed(3)
    data = [(k, v) for k, vs in {"a": [random.choice([1.0, 2.0, 2.0, 9.5, 1e6]) for _ in range(200)], "b": [3.0], "c": [1.0, 4.0], "d": [5.0] * 4, "e": [None]}.items() for v in vs]
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    want = {r.k: (r.m, r.n) for r in df.groupBy("k").agg(F.median("v").alias("m"), F.count("v").alias("n")).where("n > 0").collect()}
    assert {r.k: (r["median"], r.n) for r in counted_median(df, ["k"], "v", most=8).collect()} == want
    got = numbered(df.where("v is not null"), ["k", "v"]).collect()
    assert sorted(r.row_id for r in got) == list(range(1, 208))
    assert [(r.k, r.v) for r in sorted(got, key=lambda r: r.row_id)] == sorted((k, v) for k, v in data if v is not None)


def test_suggest(spark):
    aliases = spark.createDataFrame([("Data Engineer", 1), ("Engineer of Data", 2), ("Senior Data Analyst", 3), ("Baker", 4)], "alias string, id long")
    asked = spark.createDataFrame([("data",), ("eng",), ("Bakr",), (" ",), (None,), ("data",)], "query string")
    got = {(r.query, r["rank"]): (r.id, r.score, r.tier) for r in suggest(asked, aliases).collect()}
    assert got.pop(("Bakr", 1))[::2] == (4, "fuzzy")
    assert got == {("data", 1): (1, 1.0, "prefix"), ("data", 2): (3, 1.0, "prefix"), ("data", 3): (2, 0.9, "prefix"), ("eng", 1): (2, 1.0, "prefix"), ("eng", 2): (1, 0.9, "prefix")}
    assert suggest(asked, aliases, limit=1).count() == 3


def test_profile(spark):
    df = spark.createDataFrame([("Go and React, CI/CD",), ("pythonic",), (None,)], "t string").select(p.skills_named(F.col("t"), ["React", "CI/CD", "Python", "Go"]).alias("s"))
    rows = df.select("s", p.axis_scores(F.col("s")).alias("a")).collect()
    assert [r.s for r in rows] == [["CI/CD", "Go", "React"], ["SQL", "Python"], ["SQL", "Python"]]
    assert rows[0].a["Cloud / Infra"] == 46 and rows[1].a["Backend depth"] == 62 and rows[1].a["Leadership"] == 30 and len(rows[0].a) == 6


def test_survey_answers(spark):
    from marlstone.functions.text import experience_of, experience_of_range, month_of_epoch, posted_midpoint
    from marlstone.sources.records import survey_cells, survey_rows

    c = F.col("c")
    one = lambda f, values: [r.x for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, c string").orderBy("k").select(f(c).alias("x")).collect()]
    assert one(experience_of, ["Less than 1 year", " 2", "2.5", "9", "9.1", "More than 50 years", "NA", "", None, "5 years"]) == ["0-2", "0-2", "3-5", "6-9", "10+", "10+", "pooled", "pooled", "pooled", "pooled"]
    assert one(experience_of_range, ["Less than 1 year", "1 to 2 years", "5 to 6 years", "9 to 10 years", "20 or more years", "NA", "", None, "ten"]) == ["0-2", "0-2", "3-5", "6-9", "10+", "pooled", "pooled", "pooled", "pooled"]
    assert one(month_of_epoch, ["1700000000", "0", None, "x", "86399"]) == ["2023-11", None, None, None, "1970-01"]
    bounds = spark.createDataFrame([(1.0, 3.0), (0.0, 3.0), (2.0, None), (0.0, 0.0), (5.0, 3.0)], "a double, b double").select(posted_midpoint(F.col("a"), F.col("b")).alias("m")).collect()
    assert [r.m for r in bounds] == [2.0, 3.0, 2.0, None, 4.0]
    people = [(" India ", "12000", "Developer, back-end;Student", "4"), ("India", "NA", "Developer", "4"), ("India", "999", "Developer", "4"), ("Narnia", "12000", "Developer", "4"), ("United States", "1e6", "Astronaut", "4"), ("United States", "1000000", "Scientist", None), (None, "5000", "QA", "1"), ("Canada", "5000", None, "1")]
    rows = survey_rows(spark.createDataFrame(people, "country string, pay string, kinds string, years string"), F.lit(2019))
    assert sorted(map(tuple, rows.collect())) == [("backend", "IN", "3-5", 2019, 12000.0), ("data-sci", "US", "pooled", 2019, 1000000.0)]
    many = spark.createDataFrame([("India", str(1000 + k), "Designer", "1 to 2 years" if k % 2 else "NA") for k in range(12)], "country string, pay string, kinds string, years string")
    assert sorted(map(tuple, survey_cells(survey_rows(many, F.lit(2017), ranges=True)).collect())) == [("ux", "IN", 2017, "0-2", 1006.0, 6, "low"), ("ux", "IN", 2017, "pooled", 1006.0, 12, "low")]
