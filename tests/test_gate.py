"""Checks as data, publications that they stop, and manifests."""

import pytest

from marlstone.operators import gate
from marlstone.sources import sinks


@pytest.fixture(scope="module")
def tables(spark):
    jobs = [("a", "US", 100.0, 50, 1), ("a", "IN", 40.0, 5, None), ("b", "US", 900.0, 40, 0), ("c", None, None, 2, 1)]
    return {"jobs": spark.createDataFrame(jobs, "role string, country string, median double, n int, open int")}


def checks(spark, **more):
    anchors = spark.createDataFrame([("US", 100.0), ("IN", 50.0), ("XX", 1.0), ("ZZ", 0.0)], "country string, anchor double")
    return [
        gate.RowFloor("jobs", more.get("floor", 4)), gate.RowFloor("people", 0), gate.Contract("jobs", ["role", "median"], ["role"]), gate.Share("jobs", "open", "open > 0", 0.5),
        gate.Band("jobs", "median", "country", anchors), gate.Volume("jobs", "role", 2), gate.Suppressed("jobs", "median", "n", more.get("thin", 5)), gate.Contract("people", ["x"]),
    ]


def test_findings(spark, tables):
    got = {(r.name, r.status, r.detail) for r in gate.run_gate(spark, tables, checks(spark)).collect()}
    assert got == {
        ("floor.jobs", "pass", "4 rows, floor 4"), ("floor.people", "skip", "absent, optional"), ("contract.jobs", "pass", "held"), ("disclosure.jobs", "pass", "2 of 4, least 0.5"),
        ("sanity.jobs", "pass", "0 of 2 out of the band"), ("volume.jobs", "warn", "2 below 2"), ("suppression.jobs", "pass", "0 thin rows with a value, floor 5"), ("contract.people", "skip", "absent"),
    }
    bad = {r.name: (r.status, r.detail) for r in gate.run_gate(spark, {"jobs": tables["jobs"].drop("role")}, [gate.RowFloor("people", 3), gate.Contract("jobs", ["role"], ["country"]), gate.Volume("jobs", "role", 1)]).collect()}
    assert bad == {"floor.people": ("fail", "absent, floor 3"), "contract.jobs": ("fail", "missing role"), "volume.jobs": ("skip", "absent")}
    nulls = gate.run_gate(spark, tables, [gate.Contract("jobs", ["role"], ["country", "median", "n"])]).first()
    assert (nulls.status, nulls.detail) == ("fail", "nulls country 1, median 1")
    empty = {r.name: r.status for r in gate.run_gate(spark, {"jobs": tables["jobs"].limit(0)}, checks(spark)).collect()}
    assert empty["floor.jobs"] == "fail" and empty["disclosure.jobs"] == "fail" and empty["sanity.jobs"] == "skip" and empty["volume.jobs"] == "pass"


def test_publication_is_refused(spark, tables, tmp_path):
    root = str(tmp_path / "marts")
    findings = gate.publish_checked(tables, root, checks(spark))
    first = sinks.published(spark, root)
    assert {f[2] for f in findings} == {"pass", "warn", "skip"} and spark.read.parquet(f"{first}/jobs.parquet").count() == 4
    with pytest.raises(gate.GateError, match="floor.jobs: 4 rows, floor 9; suppression.jobs: 1 thin"):
        gate.publish_checked(tables, root, checks(spark, floor=9, thin=6))
    assert sinks.published(spark, root) == first  # readers still see the version before
    assert "fail" in {f[2] for f in gate.publish_checked(tables, root, checks(spark, floor=9), strict=False)}
    assert sinks.published(spark, root) != first


def test_rows_within_a_band(spark, tables):
    anchors = spark.createDataFrame([("US", 100.0)], "country string, anchor double")
    got = gate.within_band(tables["jobs"].where("median is not null"), "median", "country", anchors)
    assert sorted((r.role, r.country) for r in got.collect()) == [("a", "IN"), ("a", "US")] and got.columns == tables["jobs"].columns


def test_manifest_changes_with_content(spark, tmp_path):
    for name, text in (("s1/a.json", "1"), ("s1/b.json", "2"), ("s2/a.json", "1")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    from pyspark.sql import functions as F

    read = lambda: {r.source: (r.n_files, r.n_bytes, r.snapshot) for r in gate.file_manifest(spark, str(tmp_path), lambda p: F.element_at(F.split(p, "/"), -2)).collect()}
    before = read()
    assert before["s1"][:2] == (2, 2) and before["s2"][:2] == (1, 1) and read() == before
    (tmp_path / "s1/b.json").write_text("3")
    after = read()
    assert after["s1"][2] != before["s1"][2] and after["s2"] == before["s2"]
