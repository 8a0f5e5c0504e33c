"""Polite fetching as a stream: pacing and circuit breaking by host, a watchdog, and delays between tries.

A stream of requests with their answers goes through a gate of state for each host. A host has a bucket of tokens, one for
each ``gap_ms`` up to ``burst``, and a breaker: closed; open after ``threshold``
failures in a row, when requests aren't sent; half open once ``reset_ms`` have passed, when one request tries, and
closes it or opens it again. State is kept by event time and is freed by a timer once a host has been idle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The answers that count as a block.
BLOCKS = (403, 429)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@dataclass
class Gate:
    """A host's bucket and breaker; times are milliseconds."""

    gap_ms: int = 125
    burst: int = 1
    threshold: int = 5
    reset_ms: int = 30_000
    idle_ms: int = 86_400_000
    credit: int = field(default=-1)
    at: int = 0
    fails: int = 0
    opened: int = 0
    state: str = "closed"

    def fresh(self, now: int) -> None:
        self.credit, self.at, self.fails, self.opened, self.state = self.burst * self.gap_ms, now, 0, 0, "closed"

    def request(self, ts: int, failed: bool) -> tuple[str, int | None, int]:
        """What becomes of a request: (sent, ok or failed; or blocked), when it is sent, and how long it waits."""
        if self.credit < 0 or ts - self.at >= self.idle_ms:
            self.fresh(ts)
        now = max(ts, self.at)
        self.credit, self.at = min(self.burst * self.gap_ms, self.credit + now - self.at), now
        if self.state == "open":
            if now - self.opened < self.reset_ms:
                return "blocked", None, 0
            self.state = "half_open"
        wait = max(0, self.gap_ms - self.credit)
        self.credit, self.at = max(0, self.credit - self.gap_ms), now + wait
        if not failed:
            self.fails, self.state = 0, "closed"
            return "ok", self.at, wait
        self.fails += 1
        if self.state == "half_open" or self.fails >= self.threshold:
            self.state, self.opened = "open", self.at
        return "failed", self.at, wait


_STATE = "credit long, at long, fails long, opened long, state string"
_OUT = "host string, request_id long, outcome string, sent_at long, wait_ms long, state string"


class _HostGate(StatefulProcessor):
    def __init__(self, settings: dict[str, int]):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState("gate", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A host has few rows: state is asked once, and frames are made once for it and not sorted or cast.
        gate, known = Gate(**self.settings), self.kept.get()
        if known is not None:
            gate.credit, gate.at, gate.fails, gate.opened, gate.state = known
        asked = sorted((ms, request != request, request, k, failed) for k, (ms, request, failed) in enumerate(x for b in rows for x in zip(b["ms"].tolist(), b["request_id"].tolist(), b["failed"].tolist(), strict=True)))
        answers = [(request, *gate.request(ms, failed), gate.state) for ms, _, request, _, failed in asked]
        self.kept.update((gate.credit, gate.at, gate.fails, gate.opened, gate.state))
        if known is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        self.handle.registerTimer(gate.at + gate.idle_ms)
        requests, outcomes, sent, waits, states = zip(*answers, strict=True)
        yield pd.DataFrame({"host": [key[0]] * len(answers), "request_id": requests, "outcome": outcomes, "sent_at": pd.array(sent, dtype="Int64"), "wait_ms": waits, "state": states})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()  # a host that comes back after so long starts anew, with its state or without
        return iter(())

    def close(self) -> None:
        pass


def host_gate(requests: DataFrame, **settings: int) -> DataFrame:
    """(host, request_id, outcome, sent_at, wait_ms, state) of a stream of requests (host, request_id, ts, failed), with a watermark on ts.

    outcome is ok, failed or blocked (by an open circuit: not sent, null sent_at); sent_at is in milliseconds, ``wait_ms`` after
    the request; state is the breaker's, after it. Requests of one batch are taken in order of time and id; one
    that comes later than a younger one is taken at that one's time. ``settings`` are those of ``Gate``. A null host is a host,
    a null ``failed`` is no failure. The session's state store must be RocksDB (``rocks_state``).
    """
    rows = requests.select(F.coalesce("host", F.lit("")).alias("host"), "request_id", "ts", F.unix_millis("ts").alias("ms"), F.coalesce("failed", F.lit(False)).alias("failed"))
    return rows.groupBy("host").transformWithStateInPandas(_HostGate(settings), _OUT, "Append", "EventTime")


def rocks_state(spark: SparkSession) -> str | None:
    """Sets the state store that timers and state variables need; what was set before."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    return before


def watchdog(answers: DataFrame, key: str = "fleet", status: str = "status", trip_after: int = 50) -> DataFrame:
    """(key, blocks, tripped): the answers so far that are blocks, and whether a fleet has to stop."""
    counts = answers.groupBy(key).agg(F.count(F.when(F.col(status).isin(*BLOCKS), 1)).alias("blocks"))
    return counts.withColumn("tripped", F.col("blocks") >= trip_after)


def backoff(attempt: Column, base: float = 0.5, factor: float = 2.0, cap: float = 60.0) -> Column:
    """Seconds before the next try: growing by a factor, up to a cap."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(factor), attempt))
