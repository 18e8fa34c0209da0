"""Messages that are worked on until it succeeds or has failed too often, from a stream, with a ledger in the store.

A message is received at most ``most`` times. Receiving it counts an attempt and hides it for ``visibility`` seconds, which
must be longer than the work takes; work that fails, or a process that dies, leaves it to be received again after that. A
message that failed its last time, or was left behind in it, goes to the dead letters, once. Messages are known by their id:
a batch that the stream delivers again adds nothing, and what is done isn't done again.

Received messages and outcomes are two commits of keyed tables (``sinks.tables``), so several workers may share a ledger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.tables import KeyedTables, Table

# Receives of a message, seconds that a received one is hidden, days that a dead one is kept.
MOST_RECEIVES, VISIBILITY, DEAD_DAYS = 2, 960, 14
TABLES = {
    "messages": Table("id string, body string, status string, attempts int, visible_at timestamp, error string", ("id",), ("id",)),
    "dead_letters": Table("id string, body string, attempts int, error string, died_at timestamp", ("id",), ("id",)),
}
LEFT = "left behind by its worker"
_COLUMNS = [c.split()[0] for c in TABLES["messages"].schema.split(", ")]
Work = Callable[[DataFrame], DataFrame]


def receivable(messages: DataFrame, now: Column) -> DataFrame:
    """Messages that aren't done and aren't hidden."""
    return messages.filter((F.col("status") == "waiting") & (F.col("visible_at").isNull() | (F.col("visible_at") <= now)))


def received(messages: DataFrame, now: Column, most: int = MOST_RECEIVES, visibility: int = VISIBILITY) -> DataFrame:
    """Receivable messages as they are after it: one more attempt and hidden, or dead if they had their last."""
    last = F.col("attempts") >= most
    hidden = now + F.make_dt_interval(secs=F.lit(visibility))
    changed = {"status": F.when(last, "dead").otherwise("waiting"), "error": F.when(last, F.coalesce("error", F.lit(LEFT))).otherwise(F.col("error")), "visible_at": F.when(last, F.col("visible_at")).otherwise(hidden), "attempts": F.when(last, F.col("attempts")).otherwise(F.col("attempts") + 1)}
    return receivable(messages, now).withColumns(changed).select(*_COLUMNS)


def settled(messages: DataFrame, outcomes: DataFrame, most: int = MOST_RECEIVES) -> DataFrame:
    """Messages after their outcomes (id, error): done without an error; with one they wait, or are dead if it was the last."""
    told = outcomes.groupBy("id").agg(F.max("error").alias("new_error"))
    failed = F.col("new_error").isNotNull()
    status = F.when(~failed, "done").when(F.col("attempts") >= most, "dead").otherwise("waiting")
    return messages.filter("status = 'waiting'").join(told, "id").withColumns({"status": status, "error": F.col("new_error")}).select(*_COLUMNS)


class Deliveries:
    def __init__(self, spark: SparkSession, root: str, most: int = MOST_RECEIVES, visibility: int = VISIBILITY):
        self.spark, self.most, self.visibility = spark, most, visibility
        self.store = KeyedTables(spark, root, TABLES)

    def table(self, name: str = "messages") -> DataFrame:
        return self.store.read(name)

    def _change(self, rows: DataFrame, now: Column) -> dict:
        dead = rows.filter("status = 'dead'").select("id", "body", "attempts", "error", now.alias("died_at"))
        return {"messages": (rows, None), "dead_letters": (dead, None)}

    def receive(self, batch: DataFrame | None, now: Column) -> DataFrame:
        """The messages to work on: new ones of a batch (id, body) and those whose time has come again. Those that had
        their last attempt go to the dead letters instead."""

        def change(t: dict[str, DataFrame]) -> dict:
            known = t["messages"]
            if batch is not None:
                fresh = batch.groupBy("id").agg(F.min("body").alias("body")).join(known.select("id"), "id", "left_anti")
                known = known.unionByName(fresh.select("id", "body", F.lit("waiting").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("timestamp").alias("visible_at"), F.lit(None).cast("string").alias("error")))
            return self._change(self.store.stage("messages", received(known, now, self.most, self.visibility)), now)

        return self.store.update(change)["messages"][0].filter("status = 'waiting'").select("id", "body", "attempts")

    def settle(self, outcomes: DataFrame, now: Column) -> DataFrame:
        """Notes outcomes (id, error); the messages after it."""
        return self.store.update(lambda t: self._change(self.store.stage("messages", settled(t["messages"], outcomes, self.most)), now))["messages"][0]

    def run(self, work: Work, batch: DataFrame | None, now: Column) -> DataFrame:
        """Receives, works and settles. ``work`` gets (id, body, attempts) and returns (id, error), null for success; if it
        raises, all that it was given has failed with that error, and nothing is raised here."""
        mine = self.receive(batch, now)
        try:
            outcomes = self.store.stage("messages", work(mine).select("id", "error", *(F.lit(None).alias(c) for c in _COLUMNS if c not in ("id", "error"))))
        except Exception as e:  # noqa: BLE001 - whatever the work raises is its messages' error
            outcomes = mine.withColumn("error", F.lit(f"{type(e).__name__}: {e}"[:2000]))
        return self.settle(outcomes.select("id", "error"), now)

    def each(self, work: Work, clock: Callable[[], Column] = F.current_timestamp) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function for a stream of (id, body)."""

        def run(batch: DataFrame, _: int) -> None:
            self.run(work, batch, clock())

        return run

    def prune(self, now: Column, days: int = DEAD_DAYS) -> None:
        """Takes out dead letters, and the messages of them, that are older than ``days``."""
        old = F.col("died_at") < now - F.make_dt_interval(days=F.lit(days))

        def change(t: dict[str, DataFrame]) -> dict:
            gone = t["dead_letters"].filter(old)
            return {"dead_letters": (None, gone), "messages": (None, t["messages"].join(gone.select("id"), "id", "left_semi").select(*_COLUMNS))}

        self.store.update(change)
