"""The job log as a stream: requests, claims and results become transitions of one job per (tenant, repository).

The state of a key is at most one queued and one running job, so it doesn't grow with the events. A request while
a job is queued changes nothing (a burst collapses); a claim takes the queued job, or a running one that has been
silent for over 20 minutes; a result ends the running job; a running job of which nothing was heard for over two hours
fails by a timer, whether or not its key gets another event. Events of a key are put in order of time and of their
number ``seq`` within a second (without one a request goes before a claim, a claim before a result); ``fold`` is the same in batch
form, for replay and tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.events import folded

# Silence after which a running job may be claimed again, and after which it fails; seconds.
CLAIM_AFTER, DEAD_AFTER = 20 * 60, 2 * 60 * 60

EVENTS = "tenant_id long, repo_name string, kind string, trigger string, at long, seq long"
TRANSITIONS = "tenant_id long, repo_name string, job long, status string, trigger string, attempts int, at long"
_STATE = "job long, queued_trigger string, running long, started long, trigger string, attempts int"
_EMPTY = (0, None, None, None, None, 0)
_KINDS = {"request": 0, "claim": 1}
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def expired(state: tuple, now: int) -> tuple[tuple, list[tuple]]:
    """The state at ``now`` before anything else happens: a job that started over two hours ago has failed by then."""
    job, queued, running, started, by, attempts = state
    if running is None or started + DEAD_AFTER >= now:
        return state, []
    return (job, queued, None, None, None, 0), [(running, "failed", by, attempts, started + DEAD_AFTER + 1)]


def step(state: tuple, kind: str | None, trigger: str | None, at: int) -> tuple[tuple, list[tuple]]:
    """The next state and the transitions (job, status, trigger, attempts, at): ``state`` is the number of the last job,
    the trigger of the queued one, and number, start, trigger and attempts of the running one. Other kinds let time pass."""
    state, out = expired(state, at)
    job, queued, running, started, by, attempts = state
    if kind == "request" and queued is None:
        return (job + 1, trigger or "", running, started, by, attempts), [*out, (job + 1, "queued", trigger or "", 0, at)]
    if kind == "claim":
        if running is not None and started < at - CLAIM_AFTER:
            return (job, queued, running, at, by, attempts + 1), [*out, (running, "running", by, attempts + 1, at)]
        if queued is not None and running is None:
            return (job, None, job, at, queued, 1), [*out, (job, "running", queued, 1, at)]
    if kind in ("succeeded", "failed") and running is not None:
        return (job, queued, None, None, None, 0), [*out, (running, kind, by, attempts, at)]
    return state, out


def _place(kind: str | None, at: int, seq: int | None) -> tuple:
    return at, seq is None, seq or 0, _KINDS.get(kind, 2), kind or ""


def _none(x):
    """Missing values of pandas and of stored state as None, numbers as Python's."""
    return None if x is None or pd.isna(x) else x.item() if hasattr(x, "item") else x


def _frame(key: tuple, made: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(*key, *m) for m in made], columns=["tenant_id", "repo_name", "job", "status", "trigger", "attempts", "at"])


class JobStates(StatefulProcessor):
    """One key's jobs, with a timer for the running one. ``keep_ms`` lets go of keys without events for that long, and
    with them of the number of their last job; only by the machine's clock."""

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", _STATE, self.keep_ms) if self.keep_ms else handle.getValueState("job", _STATE)

    def _now(self) -> tuple:
        return tuple(_none(x) for x in self.state.get()) if self.state.exists() else _EMPTY

    def _put(self, old: tuple, new: tuple) -> None:
        self.state.update(new)
        before, after = (None if s[2] is None else 1000 * (s[3] + DEAD_AFTER + 1) for s in (old, new))
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = [tuple(_none(x) for x in r) for part in rows for r in part[["kind", "trigger", "at", "seq"]].itertuples(index=False)]
        old = now = self._now()
        out = []
        for kind, trigger, at, _ in sorted(events, key=lambda e: _place(e[0], e[2], e[3])):
            now, made = step(now, kind, trigger, at)
            out += made
        self._put(old, now)
        yield _frame(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        old = self._now()
        # This timer is spent: only what another one stands for is left to be put right.
        now, out = expired(old, expiredTimerInfo.getExpiryTimeInMs() // 1000)
        if out:
            self.state.update(now)
        yield _frame(key, out)

    def close(self) -> None:
        pass


def job_transitions(events: DataFrame, late: str = "10 minutes", clock: str = "event", keep_hours: int | None = None) -> DataFrame:
    """A stream of EVENTS becomes a stream of TRANSITIONS. By the ``event`` clock time is what the events of all keys tell,
    less ``late`` (events later than that are dropped); by the ``processing`` clock it is the machine's, and keys that
    were idle for ``keep_hours`` are let go. Timers need the RocksDB state store, which is chosen here."""
    if events.sparkSession.conf.get(_PROVIDER, "") != ROCKS:
        events.sparkSession.conf.set(_PROVIDER, ROCKS)
    if clock == "event":
        timed = events.withColumn("when", F.timestamp_seconds("at")).withWatermark("when", late)
        return timed.groupBy("tenant_id", "repo_name").transformWithStateInPandas(JobStates(), TRANSITIONS, "append", "EventTime")
    keep = keep_hours and keep_hours * 3_600_000
    return events.groupBy("tenant_id", "repo_name").transformWithStateInPandas(JobStates(keep), TRANSITIONS, "append", "ProcessingTime")


def fold(events: DataFrame, until: int | None = None) -> DataFrame:
    """The same over a table of events; timers run on to ``until``, by default the time of the last event."""
    end = until if until is not None else events.agg(F.max("at")).first()[0] or 0
    kinds = F.when(F.col("kind") == "request", 0).when(F.col("kind") == "claim", 1).otherwise(2)
    rows = events.select("tenant_id", "repo_name", "at", F.col("seq").isNull().alias("unnumbered"), "seq", kinds.alias("place"), "kind", "trigger")

    def each(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        return step(state, row[4], row[5], row[0])

    return folded(rows, ["tenant_id", "repo_name"], ["at", "unnumbered", "seq", "place", "kind"], _EMPTY, each, lambda state: expired(state, end)[1], TRANSITIONS)
