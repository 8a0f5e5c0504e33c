"""Operators on small tables, against plain Python."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.operators import aggregate, curve, hedonic, knn, lookup, trend, upsert, windows
from marlstone.operators.components import components


@pytest.fixture
def feeds(spark):
    return spark.createDataFrame([("a", 2, "x", 1), ("a", 1, "y", 2), ("b", 5, "z", 3), ("a", 1, "w", 4)], "k string, rank int, v string, seq int")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_upserts(spark, feeds):
    assert rows(upsert.by_priority(feeds, ["k"], "rank", ["seq"]).select("k", "v")) == [("a", "y"), ("b", "z")]
    there = spark.createDataFrame([("a", 0, "old", 0)], feeds.schema)
    assert rows(upsert.first_wins(there, feeds, ["k"], ["seq"]).select("k", "v")) == [("a", "old"), ("b", "z")]
    assert rows(upsert.last_wins(there, feeds, ["k"], [F.desc("seq")]).select("k", "v")) == [("a", "w"), ("b", "z")]
    assert rows(upsert.fill_gaps(there, feeds.where("seq <> 1"), ["k"]).select("k", "v")) == [("a", "old"), ("b", "z")]
    assert rows(upsert.append_new(there, feeds, ["k"]).select("k")) == [("b",)]
    assert rows(upsert.update_values(feeds.where("seq in (2, 3)"), there, ["k"], "v").select("k", "v")) == [("a", "old"), ("b", "z")]


def test_nearest_rank_is_half_even(spark):
    for n in (1, 2, 3, 6, 10):
        df = spark.createDataFrame([("a", float(x)) for x in range(n)] + [("a", None)], "k string, v double")
        got = aggregate.nearest_rank(df, ["k"], "v", {"q": 0.5}).first()
        assert (got.n, got.q) == (n, round(0.5 * (n - 1))) and aggregate.upper_median(df, ["k"], "v").first().upper_median == n // 2


def test_grains(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "pooled", 3), ("b", "x", 4)], "k string, band string, v int")
    got = rows(aggregate.with_pooled(df, ["k"], "band", [F.sum("v").alias("s")]).select("k", "band", "s"))
    assert got == [("a", "pooled", 6), ("a", "x", 1), ("a", "y", 2), ("b", "pooled", 4), ("b", "x", 4)]
    assert rows(aggregate.with_total(df, "k", [F.sum("v").alias("s")]).select("k", "s")) == [("*", 10), ("a", 6), ("b", 4)]
    assert rows(aggregate.top_items(df, ["k"], "band", 1)) == [("a", '["pooled"]'), ("b", '["x"]')]


def test_pairs_and_mode(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "b"), (3, "a")] + [(4, c) for c in "abcdef"], "g int, i string")
    assert rows(aggregate.pair_counts(df, "g", "i", 2)) == [("a", "b", 2)]
    assert rows(aggregate.mode_first_seen(df.where("g = 1").withColumn("p", F.when(F.col("i") == "a", 0).otherwise(1)), ["g"], "i", "p")) == [(1, "b", 2)]


def test_windows(spark):
    df = spark.createDataFrame([("a", y, v) for y, v in ((1, None), (2, 5.0), (3, None), (4, 7.0))], "k string, y int, v double")
    assert [r.v for r in windows.carry(df, ["k"], "y", "v").orderBy("y").collect()] == [5, 5, 5, 7]
    assert rows(windows.latest(df, ["k"], "y", ["v"])) == [("a", 7.0)]
    assert rows(windows.momentum(df.where("v is not null"), ["k"], "y", "v")) == [("a", 4, 7.0, 40.0)]
    assert [(r.step, r.climb) for r in windows.steps(df.where("v is not null"), ["k"], "y", "v").orderBy("y").collect()] == [(None, 0.0), (2.0, 2.0)]


def test_forecast_bands_widen(spark):
    df = spark.createDataFrame([("a", y, 20.0 + 3 * y + (y % 2)) for y in range(9)], "k string, y int, v double")
    got = trend.forecast(df, ["k"], "y", "v").orderBy("y").collect()
    assert len(got) == 3 and all(r.lo <= r.value <= r.hi for r in got) and got[0].hi - got[0].lo <= got[2].hi - got[2].lo
    assert trend.backtest(df.where("y < 3"), ["k"], "y", "v").count() == 0


def test_curve_is_monotone_and_ends_with_the_points():
    points = pd.DataFrame({"low": [0.0, 2, 4, 10], "high": [2.0, 4, 6, 40], "median": [50.0, 40, 70, 90], "n": [9, 9, 4, 1]})
    got = curve.fit_curve(points)
    assert (got["value"].diff().dropna() >= -1e-9).all() and got["year"].min() >= 1 and got["year"].max() <= 10
    assert ((got["lo"] < got["value"]) & (got["value"] < got["hi"])).all()
    assert curve.fit_curve(points.head(1)).empty
    x = np.array([0.0, 1, 2, 3])
    assert np.allclose(curve.monotone_cubic(x, x * 2, np.array([0.5, 2.5])), [1, 5]) and np.isnan(curve.monotone_cubic(x, x, np.array([3.5]))).all()


def test_hedonic_recovers_a_premium(spark):
    rng = np.random.default_rng(1)
    data = [(k, float(np.exp(10 + 0.2 * (k % 2) + 0.5 * (k % 3 == 0) + rng.normal() * 0.01)), ["x"] if k % 2 else ["y"], "c" if k % 3 == 0 else "d") for k in range(2000)]
    got = {r.item: r for r in hedonic.premiums(spark.createDataFrame(data, "id long, p double, s array<string>, c string"), "p", "s", ["c"], "id", replicas=5).collect()}
    gap = (1 + got["x"].premium_pct / 100) / (1 + got["y"].premium_pct / 100)
    assert abs(gap - np.exp(0.2)) < 0.01 and got["x"].r2 > 0.99 and got["x"].lo_pct <= got["x"].premium_pct + 1 and got["x"].n == 1000


def test_lookups(spark):
    aliases = spark.createDataFrame([("data", "D"), ("data scientist", "DS"), ("ml", "M")], "alias string, entity string")
    names = spark.createDataFrame([("lead data scientist",), ("ml",), ("ml person",), ("database",)], "name string")
    assert rows(lookup.longest_contained(names, "name", aliases)) == [("lead data scientist", "DS", False), ("ml", "M", True)]
    codes = spark.createDataFrame([("15-1252", "base"), ("15-1252.01", "exact")], "code string, v string")
    df = spark.createDataFrame([("15-1252.01",), ("15-1252.99",), ("11-0000.00",)], "c string")
    assert rows(lookup.two_level(df, "c", codes, 7, "v").select("c", "v").fillna("")) == [("11-0000.00", ""), ("15-1252.01", "exact"), ("15-1252.99", "base")]
    got = lookup.best_trigram_match(names, "name", aliases, "alias").where("name = 'database'").first()
    assert got.alias == "data"


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (103, 101), (7, 7)], "u long, v long")
    got = dict(map(tuple, components(edges).collect()))
    assert all(got[k] == 0 for k in range(41)) and got[100] == got[103] == 100


def test_nearest_and_groups(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    x[100:120] = x[5] + rng.normal(size=(20, 8)) * 0.01
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>").repartition(3)
    got = knn.nearest(df.where("id % 100 = 0"), df, "id", "v", k=4, least=-1.0).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 100, 200):
        want = [i for i in np.argsort(-(unit @ unit[q])) if i != q][:4]
        assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want
    group = dict(map(tuple, knn.similarity_groups(df, "id", "v", least=0.99).collect()))
    assert {group[k] for k in range(100, 120)} == {group[5]} and len(group) == 300


def test_similarity_groups_hold_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1500:] = 0.75 * x[:1500] + np.sqrt(1 - 0.75**2) * x[1500:]  # planted pairs, cosine about 0.75
    x[2900:] = x[7]
    want = np.arange(3000)
    near = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= 0.68
    while not np.array_equal(now := np.where(near, want[None, :], 3000).min(axis=1), want):
        want = now
    monkeypatch.setattr(knn, "BLOCK", 700)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(3000, None), (3001, [0.0] * 64)], "id long, v array<double>")
    got = dict(map(tuple, knn.similarity_groups(df, "id", "v").collect()))
    assert got == {**dict(enumerate(want.tolist())), 3000: 3000, 3001: 3001}


def test_resolve_is_that_of_a_plain_scan(spark):
    from difflib import SequenceMatcher

    from marlstone.operators.lookup import resolve

    aliases = [("software engineer", 1), ("software developer", 1), ("data scientist", 2), ("data engineer", 3), ("react developer", 4), ("ml ops", 5)]
    asked = ["Senior Software Enginer", "Data Scientist II", "react", "scientist data", "ml", "engineer", "q", "Sftware devloper", "dta enginr"]
    names = {"Senior Software Enginer": "software enginer", "Data Scientist II": "data scientist", "Sftware devloper": "sftware devloper"}

    def trigrams(s):
        s = f"  {s} "
        return {s[i : i + 3] for i in range(len(s) - 2)}

    def similarity(q, a):
        part = lambda x, y: len(x & y) / len(x | y)
        best = max(SequenceMatcher(None, q, a).ratio(), part(trigrams(q), trigrams(a)), part(set(q.split()), set(a.split())))
        return max(best, 0.8) if len(q) >= 4 and (q in a or a in q) else best

    got = {r["query"]: r for r in resolve(spark.createDataFrame([(q,) for q in asked], "query string"), spark.createDataFrame(aliases, "alias string, id long")).collect()}
    for q in asked:
        n = names.get(q, q)
        score, best = min((-similarity(n, a), i) for a, i in aliases)
        if -score >= 0.3:
            assert got[q].id == best and abs(got[q].score + score) < 1e-9, q
            assert got[q].tier == ("exact" if n in dict(aliases) else "fuzzy") and got[q].confidence == ("high" if -score >= 0.82 else "med" if -score >= 0.55 else "low")
    assert got["q"].id is None and got["q"].confidence == "low"


def test_components_of_paths_and_stars(spark):
    from marlstone.operators.components import components

    edges = [(k, k + 1) for k in range(100, 260)] + [(5000, k) for k in range(1000, 2500)] + [(7, 7), (None, 3)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{k: 100 for k in range(100, 261)}, **{k: 1000 for k in range(1000, 2500)}, 5000: 1000}


def test_long_aliases_are_found(spark):
    names = spark.createDataFrame([("the very senior chief data platform architect role",)], "name string")
    aliases = spark.createDataFrame([("chief data platform architect role", "A"), ("data", "D")], "alias string, entity string")
    assert lookup.longest_contained(names, "name", aliases).first().entity == "A"


def test_sources_are_replaced(spark):
    from marlstone.sources.sinks import delete_by_source

    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "source string, v long")
    new = spark.createDataFrame([("a", 9), ("c", 4)], "source string, v long")
    assert sorted(map(tuple, delete_by_source(old, new, "source").collect())) == [("a", 9), ("b", 3), ("c", 4)]


def test_medians_of_large_groups(spark):
    """A hot group, a huge outlier, one value in most rows, few rows, nulls and null keys."""
    rng = np.random.default_rng(8)
    groups = {"hot": [*rng.lognormal(10, 2, 4001), 1e300], "even": list(rng.normal(size=1500)), "same": [7.0] * 1200 + list(rng.normal(size=700)), "two": [1.0] * 900 + [2.0] * 900, "few": [3.0, 1.0], None: list(rng.normal(size=1000)), "none": [None] * 1300}
    data = [(k, v, "x") for k, vs in groups.items() for v in map(lambda v: v if v is None else float(v), vs)]
    df = spark.createDataFrame(data, "k string, v double, w string").repartition(5)
    half = F.when(F.col("v") > 0, F.col("v"))
    extra = [F.count("v").alias("n")]
    want = sorted(map(repr, df.groupBy("k").agg(F.median("v").alias("m"), F.median(half).alias("h"), *extra).collect()))
    for most in (50, 1_000_000):
        assert sorted(map(repr, aggregate.medians(df, ["k"], {"m": F.col("v"), "h": half}, extra, most=most, k=256).collect())) == want
    assert sorted(map(repr, aggregate.medians(df, ["k"], {"m": F.col("v"), "h": half}, extra, bound=len(data)).collect())) == want
    assert aggregate.medians(df.limit(0), ["k"], {"m": F.col("v")}).count() == 0
    assert aggregate.medians(df.where("k = 'hot'"), ["w", "k"], {"m": F.col("v")}, most=10, k=64).first()["m"] == np.median(groups["hot"])
