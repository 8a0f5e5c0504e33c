"""Registries and outlooks."""

import datetime as dt
import json

from pyspark.sql import functions as F

from marlstone.sources.adoption import located_downloads, outlook_series, package_downloads, plain_number


def test_registries(spark):
    p = "2024-05"
    crates = {"version_downloads": [{"date": "2024-05-01", "downloads": 3}, {"date": "2024-05-02", "downloads": 4}, {"date": "2024-04-30", "downloads": 9}], "meta": {"extra_downloads": [{"date": "x", "downloads": 50}]}}
    answers = [
        ("npm", "react", {"downloads": [{"day": "2024-05-01", "downloads": 5}, {"day": "2024-05-02", "downloads": None}, {"day": "2024-05-03", "downloads": 6}]}), ("npm", "none", {"downloads": []}), ("npm", "error", {"error": "not found"}),
        ("crates", "serde", crates), ("crates", "old", crates | {"version_downloads": []}), ("nuget", "json", {"data": [{"totalDownloads": 12}, {"totalDownloads": 99}]}), ("nuget", "gone", {"data": []}),
        ("rubygems", "rails", {"downloads": 7}), ("maven", "org.x:core", {"response": {"numFound": 8}}), ("maven", "core", {"response": {"numFound": 8}}), ("pypi", "numpy", {"downloads": 7}),
    ]
    rows = [(e, n, f"s-{n}", p, json.dumps(a)) for e, n, a in answers] + [("npm", "broken", "s", p, "<html>"), ("npm", "null", "s", p, None)]
    got = package_downloads(spark.createDataFrame(rows, "ecosystem string, package string, skill string, period string, payload string")).collect()
    assert {(r.ecosystem, r.package): r.downloads for r in got} == {("npm", "react"): 11, ("crates", "serde"): 7, ("crates", "old"): 50, ("nuget", "json"): 12, ("rubygems", "rails"): 7, ("maven", "org.x:core"): 8}
    assert all(r.country == "" and r.period == p and r.skill == f"s-{r.package}" for r in got)


def test_located_downloads(spark):
    at = lambda month: dt.datetime(2024, month, 3)
    log = [("numpy", "IN", at(5)), ("numpy", "in", at(5)), ("numpy", "IN", at(6)), ("numpy", "FR", at(5)), ("numpy", None, at(5)), ("other", "IN", at(5)), ("pandas", "US", at(5))]
    got = located_downloads(spark.createDataFrame(log, "package string, country_code string, ts timestamp"), spark.createDataFrame([("numpy", "np"), ("pandas", "pd")], "package string, skill string"), ("IN", "US"))
    assert sorted(map(tuple, got.collect())) == [("pypi", "numpy", "np", "2024-05", 2, "IN"), ("pypi", "numpy", "np", "2024-06", 1, "IN"), ("pypi", "pandas", "pd", "2024-05", 1, "US")]


def test_outlooks(spark):
    numbers = spark.createDataFrame([(x,) for x in ("12.3%", " 1,234 ", "-2.0", "", "-", "N/A", "..", "*", None, "x")], "c string").select(plain_number(F.col("c")).alias("n")).collect()
    assert [r.n for r in numbers] == [12.3, 1234.0, -2.0] + [None] * 7
    series = [("EPU15125200000006 ", "17.9"), ("EPU15125200000007", "140,100"), ("EPU15-125300000006", "5"), ("EPU15125200000009", "1"), ("EPUXX06", "3"), ("EPU15125200000006", "-")]
    got = outlook_series(spark.createDataFrame(series, "series_id string, value string"), spark.createDataFrame([("151252", "Software developers")], "code string, name string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [("US", "SOC", "15-1252", "2023-2033", 17.9, None, "Software developers"), ("US", "SOC", "15-1252", "2023-2033", None, 140100.0, "Software developers"), ("US", "SOC", "15-1253", "2023-2033", 5.0, None, None)], key=str
    )
