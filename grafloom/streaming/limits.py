"""Rate windows, failure back-off and throttled touches as streams with a few numbers of state a key.

Times are whole seconds. A window is anchored at its first hit and starts anew with the first hit that is later
than its width. Failures beyond three lock for 2, 4, 8 ... seconds up to 15 minutes; from ``lock_after`` on they
lock for ``lock_seconds``, doubled each time up to a day, and are counted anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import folded

# Failures that are free, the longest back-off and the longest lock.
FREE_FAILURES, MOST_BACKOFF, MOST_LOCK = 3, 15 * 60, 24 * 60 * 60

HITS = "key string, at long"
WINDOWED = "key string, at long, hits int, allowed boolean, retry_after long"
LOCKED = "key string, at long, failures int, locked_for long, locked_until long"
TOUCHED = "key string, at long"


def hit(state: tuple | None, at: int, limit: int, width: int) -> tuple[tuple, tuple]:
    """(window start, hits) after a hit, and what it is told: hits, allowed, seconds until the window ends."""
    start, hits = state or (at, 0)
    start, hits = (at, 1) if start < at - width else (start, hits + 1)
    return (start, hits), (hits, hits <= limit, max(1, start + width - at))


def failure(state: tuple | None, at: int, width: int, lock_after: int, lock_seconds: int) -> tuple[tuple, tuple]:
    """(window start, failures, locked until, level) after a failure, and what it is told: failures, the lock's
    seconds, and until when the key is locked."""
    start, failures, until, level = state or (at, 0, 0, 0)
    if start < at - width and until < at:
        start, failures = at, 0
    failures += 1
    told = failures
    wait = 0
    if failures >= lock_after:
        wait = min(lock_seconds * 2**level, MOST_LOCK)
        start, failures, level = at, 0, level + 1
    elif failures > FREE_FAILURES:
        wait = min(2 ** (failures - FREE_FAILURES), MOST_BACKOFF)
    if wait:
        until = max(until, at + wait)
    return (start, failures, until, level), (told, wait, until)


def touch(state: tuple | None, at: int, every: int) -> tuple[tuple, tuple | None]:
    """The time last written after a use, and an empty answer if this use is to be written."""
    if state is None or state[0] < at - every:
        return (at,), ()
    return state, None


def _rows(key: tuple, events: pd.DataFrame, state: tuple | None, rule: Callable, names: list[str]) -> tuple[tuple | None, pd.DataFrame]:
    out = []
    for at in events["at"].sort_values(kind="stable"):
        state, told = rule(state, int(at))
        if told is not None:
            out.append((*key, int(at), *told))
    return state, pd.DataFrame(out, columns=names)


def _stream(events: DataFrame, rule: Callable, out: str, kept: str) -> DataFrame:
    names = [c.split()[0] for c in out.split(", ")]
    if not events.isStreaming:

        def each(state: tuple | None, row: tuple) -> tuple[tuple | None, list[tuple]]:
            state, told = rule(state, row[0])
            return state, [] if told is None else [(row[0], *told)]

        return folded(events.select("key", "at"), ["key"], ["at"], None, each, lambda _: [], out)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(int(x) for x in state.get) if state.exists else None
        now, rows = _rows(key, pd.concat(batches), now, rule, names)
        state.update(now)
        yield rows

    return events.groupBy("key").applyInPandasWithState(run, out, kept, "append", GroupStateTimeout.NoTimeout)


def rate_windows(hits: DataFrame, limit: int, width: int) -> DataFrame:
    """Each hit with the hits of its window, whether it is allowed, and the seconds until the window ends."""
    return _stream(hits, lambda s, at: hit(s, at, limit, width), WINDOWED, "start long, hits long")


def failure_locks(failures: DataFrame, width: int, lock_after: int = 10, lock_seconds: int = 900) -> DataFrame:
    """Each failure with the failures that count and the lock that it sets."""
    return _stream(failures, lambda s, at: failure(s, at, width, lock_after, lock_seconds), LOCKED, "start long, failures long, until long, level long")


def throttled(uses: DataFrame, every: int = 60) -> DataFrame:
    """The uses that are written down: those over ``every`` seconds after the one written before."""
    return _stream(uses, lambda s, at: touch(s, at, every), TOUCHED, "at long")
