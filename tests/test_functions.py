"""Expressions on literal pairs."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import score, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("given", "want"), [
        ("Sr. Software Engineer II", "software engineer"), ("Senior Data Engineer", "data engineer"), ("Staff Data Engineer", "data engineer"), ("Junior Frontend Engineer", "frontend engineer"), ("Tech Lead", "tech lead"),
        ("Head of Engineering", "head of engineering"), ("Engineering Lead", "engineering lead"), ("technical lead manager", "technical lead manager"), ("Director of Engineering", "director of engineering"), ("Staff", "staff"), ("Senior", "senior"),
        ("C++ Engineer", "c++ engineer"), ("CI/CD Engineer", "ci/cd engineer"), ("", ""), (None, ""), ("Distinguished Vice  President of Sales 3", "of sales"),
    ])
def test_normalize_surface(spark, given, want):
    assert one(spark, text.normalize_surface(F.col("c")), c=given) == want


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (text.slug, "  A&B, C ", "a-b-c"), (text.canon_title, "Lead Data-Scientist III", "data scientist"), (text.norm_employer, "Acme, Inc.", "acme"), (text.norm_employer, "Foo Technologies Pvt. Ltd", "foo"), (text.norm_employer, "Banco AG", "banco ag"), (text.remote_flag, "on-site only, remote later", False), (text.remote_flag, "remotely", False),
        (text.wage_band, "Level II", "3-5"), (text.wage_band, "4", "10+"), (text.wage_band, "level 1", None), (text.wage_band, "entry", "0-2"), (text.parse_number, "$1,234.5", 1234.5), (text.parse_number, "n/a", None),
        (text.horizon_years, "2023-2033", 10), (text.horizon_years, "3yr", 3), (text.horizon_years, "current", None), (text.horizon_years, "long", 10), (text.years_mentioned, "2 yrs and 7+ years", 7), (text.years_mentioned, "none", 4),
        (text.month_of, "Who is hiring? (March 2021)", "2021-03"), (text.month_of, "nothing", None), (text.remote_flag, "Remote ok", True), (text.remote_flag, "no remote", False), (text.strip_html, "<p>a &amp; b</p><script>x</script> c", "a & b c"),
        (text.surt, "https://a.b.example.com/x/y", "com,example,b,a"), (text.tail_of, "http://x/y/z", "z"), (text.indian_digits, "12345678", "1,23,45,678"), (text.indian_digits, "999", "999"),
    ],
)
def test_text(spark, f, given, want):
    assert one(spark, f(F.col("c")), c=given) == want


def test_pay_band(spark):
    low, high = text.pay_band(F.col("c"))
    assert (one(spark, low, c="$150k - 120k"), one(spark, high, c="$150k - 120k")) == (120_000, 150_000)
    assert one(spark, low, c="1 - 2") is None


def test_sets(spark):
    assert one(spark, text.extract_terms(F.col("c"), ["java", "javascript", "sql"]), c="SQL, JavaScript and sql; javax") == ["sql", "javascript"]
    assert one(spark, F.size(text.shingles(F.split("c", " "))), c="a b c d e f") == 2 and one(spark, F.size(text.shingles(F.split("c", " "))), c="a b") == 1
    assert one(spark, text.jaccard(text.trigrams(F.col("c")), text.trigrams(F.col("d"))), c="abc", d="abc") == 1.0


def test_score(spark):
    rows = spark.createDataFrame([("a", 0.0), ("a", 5.0), ("a", 10.0), ("b", 3.0)], "k string, v double")
    assert sorted(r.x for r in rows.select(score.min_max(F.col("v"), "k").alias("x")).collect()) == [0.0, 0.5, 0.5, 1.0]
    assert one(spark, score.nice(F.col("c"), F.lit(50.0)), c=125.0) == 150.0 and one(spark, score.per_cent_change(F.col("c"), F.lit(0.0)), c=3.0) is None
    assert one(spark, score.clamp(F.col("c"), 12, 99), c=5.0) == 12 and one(spark, score.growth(F.lit(0.0), F.col("c")), c=5.0) == 0


@pytest.mark.parametrize(("years", "band"), [(1.0, "0-2"), (5.0, "3-5"), (9.0, "6-9"), (10.0, "10+")])
def test_bands(spark, years, band):
    assert one(spark, text.experience_band(F.col("c")), c=years) == band
    assert one(spark, text.confidence(F.col("c"), 200, 40), c=years) == "low"
    assert one(spark, text.annualise(F.col("c"), F.lit("hour")), c=years) == 2080 * years and one(spark, text.annualise(F.col("c"), F.lit("?")), c=years) is None
