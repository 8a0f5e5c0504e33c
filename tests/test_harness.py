"""Polite fetching: the gate's rules, and the stream against a plain run."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.streaming import harness
from marlstone.streaming.events import run_available


def test_bucket_paces():
    g = harness.Gate(gap_ms=100)
    assert [g.request(t, False) for t in (0, 0, 500, 550)] == [("ok", 0, 0), ("ok", 100, 100), ("ok", 500, 0), ("ok", 600, 50)]
    g = harness.Gate(gap_ms=100, burst=3)
    assert [g.request(0, False)[2] for _ in range(5)] == [0, 0, 0, 100, 100]


def test_breaker_opens_and_half_opens():
    g = harness.Gate(gap_ms=1, threshold=3, reset_ms=5_000)
    for k in range(3):
        assert g.request(100 * k, True)[0] == "failed"
    assert g.state == "open" and g.request(300, False) == ("blocked", None, 0)
    assert g.request(5_199, False)[0] == "blocked" and g.request(5_200, True)[0] == "failed" and g.state == "open"  # the trial fails
    assert g.request(10_100, False)[0] == "blocked" and g.request(10_200, False)[0] == "ok" and g.state == "closed" and g.fails == 0


def test_idle_hosts_start_anew():
    g = harness.Gate(gap_ms=1, threshold=1, reset_ms=10**9, idle_ms=1_000)
    assert g.request(0, True)[0] == "failed" and g.state == "open" and g.request(999, False)[0] == "blocked"
    assert g.request(1_999, False)[0] == "ok" and g.state == "closed"


def test_backoff_is_capped(spark):
    rows = spark.createDataFrame([(k,) for k in (0, 1, 2, 10)], "n int").select(harness.backoff(F.col("n"), cap=10.0).alias("d")).collect()
    assert [r.d for r in rows] == [0.5, 1.0, 2.0, 10.0]


def test_watchdog_counts_blocks(spark):
    answers = [("a", 200), ("a", 500), ("a", 403), ("a", 429), ("a", 403), ("b", 429), ("b", None)]
    got = {r.fleet: (r.blocks, r.tripped) for r in harness.watchdog(spark.createDataFrame(answers, "fleet string, status int"), trip_after=3).collect()}
    assert got == {"a": (3, True), "b": (1, False)}


@pytest.fixture
def rocks(spark):
    before = harness.rocks_state(spark)
    yield
    spark.conf.set(harness.PROVIDER, before) if before else spark.conf.unset(harness.PROVIDER)


def test_stream_goes_on_from_its_state(spark, rocks, tmp_path):
    rng, start = random.Random(2), dt.datetime(2024, 1, 1)
    settings = {"gap_ms": 4_000, "burst": 2, "threshold": 2, "reset_ms": 20_000, "idle_ms": 600_000}
    requests, at = [], 0
    for k in range(240):
        at += rng.randint(0, 6_000) if k != 120 else 900_000
        requests.append((rng.choice(["a", "b", "b", None]), k, start + dt.timedelta(milliseconds=at), rng.choice([True, False, None])))
    schema = "host string, request_id long, ts timestamp, failed boolean"
    gates, want = {}, []
    for host, k, ts, failed in requests:
        gate = gates.setdefault(host or "", harness.Gate(**settings))
        ms = int((ts - start).total_seconds() * 1000 + 0.5) + 1_704_067_200_000
        want.append((host or "", k, *gate.request(ms, bool(failed)), gate.state))
    for part, own in enumerate((requests[:100], requests[100:121], requests[121:])):
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 second")
        run_available(harness.host_gate(stream, **settings), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        seen = sum(map(len, (requests[:100], requests[100:121], requests[121:])[: part + 1]))
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        assert sorted((r.host, r.request_id, r.outcome, r.sent_at, r.wait_ms, r.state) for r in rows) == sorted(want[:seen])
    assert {"ok", "failed", "blocked"} == {w[2] for w in want}


def test_state_is_asked_once_for_a_host():
    """Each call is a trip to the other process; rows of several batches are one sequence, ids that are missing come last."""
    calls = []

    class Store:
        def __init__(self, kept=None):
            self.kept = kept

        def __getattr__(self, name):
            return lambda *x: calls.append(name) or {"get": self.kept, "exists": self.kept is not None, "listTimers": [7]}.get(name, self)

    batches = [pd.DataFrame({"ms": [5, 9], "request_id": [2.0, 4.0], "failed": [True, False]}), pd.DataFrame({"ms": [5, 5], "request_id": [float("nan"), 1.0], "failed": [False, True]})]
    for kept, timers in ((None, []), ((1, 0, 0, 0, "closed"), ["listTimers", "deleteTimer"])):
        gate = harness._HostGate({"gap_ms": 1, "threshold": 2, "reset_ms": 100})
        gate.handle = gate.kept = Store(kept)
        calls.clear()
        (out,) = gate.handleInputRows(("h",), iter(batches), None)
        assert calls == ["get", "update", *timers, "registerTimer"]
        assert out["request_id"].tolist()[:2] == [1, 2] and out["request_id"].tolist()[3] == 4 and out["outcome"].tolist() == ["failed", "failed", "blocked", "blocked"]
