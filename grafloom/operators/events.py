"""Change detection, job log and rate-window operators in batch form (as streams: ``streaming``)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

def change_set(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo, path, change) between two listings of (repo, path, hash): added, changed, same, deleted."""
    a, b = (df.select("repo", "path", F.col("hash").alias(side), F.lit(True).alias(f"in_{side}")) for df, side in ((old, "old"), (new, "new")))
    kind = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "deleted").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return a.join(b, ["repo", "path"], "full").select("repo", "path", kind.alias("change"))


def latest_job(jobs: DataFrame) -> DataFrame:
    """The last job of each connection, by a partial aggregate: no sort, no hot window."""
    pick = F.max_by(F.struct("id", "status", "trigger"), F.struct("created_at", "id"))
    return jobs.groupBy("tenant_id", "repo_name").agg(pick.alias("j")).select("tenant_id", "repo_name", "j.*")


def recent_jobs(jobs: DataFrame, limit: int = 25) -> DataFrame:
    return jobs.select("id", "tenant_id", "repo_name", "trigger", "status", "created_at").orderBy(F.desc("created_at"), F.desc("id")).limit(limit).drop("created_at")


def queued_collapse(jobs: DataFrame) -> DataFrame:
    """One queued job per (tenant, repo): the first, and how many requests it stands for."""
    return jobs.filter("status = 'queued'").groupBy("tenant_id", "repo_name").agg(F.min("id").alias("id"), F.count("*").alias("requests"))


def claimable(jobs: DataFrame, now: Column, stale: str = "20 minutes") -> DataFrame:
    """Jobs a worker may take: queued, or running for longer than ``stale``."""
    return jobs.filter((F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("started_at") < now - F.expr(f"INTERVAL '{stale}'"))))


STALE_ERROR = "stale: worker died"


def dead(now: Column, stale: str = "2 hours") -> Column:
    """Whether a job has been running for longer than ``stale``."""
    return (F.col("status") == "running") & (F.col("started_at") < now - F.expr(f"INTERVAL '{stale}'"))


def fail_stale(jobs: DataFrame, now: Column, stale: str = "2 hours") -> DataFrame:
    """The job table with dead jobs failed and, where it has the column, finished now."""
    gone = dead(now, stale)
    changed = {"error": F.when(gone, F.lit(STALE_ERROR)).otherwise(F.col("error")), "status": F.when(gone, F.lit("failed")).otherwise(F.col("status"))}
    if "finished_at" in jobs.columns:
        changed["finished_at"] = F.when(gone, now).otherwise(F.col("finished_at"))
    return jobs.withColumns(changed)


def retention(rows: DataFrame, column: str, now: Column, keep: str) -> DataFrame:
    """Rows not older than ``keep``."""
    return rows.filter(F.col(column) >= now - F.expr(f"INTERVAL '{keep}'"))


def folded(rows: DataFrame, keys: list[str], order: list[str], start: object, step: Callable, finish: Callable, schema: str) -> DataFrame:
    """Rows (keys, then others) folded key by key in ``order``: ``step(state, others)`` gives the next state and the rows told
    (without the keys), ``finish(state)`` those at a key's end. A key's rows are read as they come, sorted by the engine, so
    a hot key needs time but no memory."""
    names = [c for c in rows.columns if c not in keys]
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, state = [], None, start

        def made() -> pa.RecordBatch:
            cols = zip(*out, strict=True) if out else [()] * len(kinds)
            return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(cols, kinds, strict=True)], schema=kinds)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = row[: len(keys)]
                if key != now:
                    if now is not None:
                        out += [(*now, *t) for t in finish(state)]
                    now, state = key, start
                state, told = step(state, row[len(keys) :])
                out += [(*key, *t) for t in told]
            if len(out) > 10_000:
                yield made()
                out = []
        if now is not None:
            out += [(*now, *t) for t in finish(state)]
        yield made()

    return rows.select(*keys, *names).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _windows(hits: DataFrame, width: int, every: bool) -> DataFrame:
    """(key, window_start, hits) of each key's last window, or of every one. Hits of one time are counted before the
    shuffle; each key's times are then read in order and folded as they come: a hot key needs time but no memory."""
    schema = T.StructType([hits.schema["key"], T.StructField("window_start", T.LongType()), T.StructField("hits", T.IntegerType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, kind = [], None, None

        def made(rows: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32())], ["key", "window_start", "hits"])

        for batch in batches:
            kind = batch.column(0).type
            for k, t, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                other = now is not None and k != now[0]
                if now is not None and (other or (every and now[1] < t - width)):
                    out.append(tuple(now))
                if now is None or other or now[1] < t - width:
                    now = [k, t, 0]
                now[2] += m
            if len(out) > 10_000:
                yield made(out)
                out = []
        if now is not None:
            yield made([*out, tuple(now)])

    times = hits.filter("t is not null").groupBy("key", "t").agg(F.count("*").alias("m"))
    return times.repartition("key").sortWithinPartitions("key", "t").mapInArrow(fold, schema)


def rate_window_fold(hits: DataFrame, width: int) -> DataFrame:
    """(key, window_start, hits) after all hits in order: a window starts at its first hit and a later hit
    beyond it starts the next."""
    return _windows(hits, width, False)


def window_starts(hits: DataFrame, width: int) -> DataFrame:
    """(key, window_start, hits) of every such window."""
    return _windows(hits, width, True)


def lockout(failures: Column, level: Column, free: int = 3, lock_after: int = 10, lock_seconds: int = 900) -> Column:
    """Seconds to wait: doubling beyond ``free`` failures up to 15 minutes; from ``lock_after`` on the lock,
    doubling with its level up to a day."""
    lock = F.least(F.lit(lock_seconds) * F.pow(F.lit(2), level), F.lit(86_400))
    back = F.when(failures > free, F.least(F.pow(F.lit(2), failures - free), F.lit(900))).otherwise(F.lit(0))
    return F.when(failures >= lock_after, lock).otherwise(back).cast("long")


def replay_guard(events: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """Whether each step is beyond all earlier ones of its user. The greatest step of each slice of time comes first,
    so that a hot user's events are dealt by slice and only a row for each slice is put in one order."""
    rows = events.select("event_id", "user_id", "ts", "step", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / slice_seconds).alias("slice"))
    earlier = Window.partitionBy("user_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy("user_id", "slice").agg(F.max("step").alias("top")).withColumn("before", F.max("top").over(earlier))
    tops = tops.select(F.col("user_id").alias("u"), F.col("slice").alias("s"), "before")
    within = Window.partitionBy("user_id", "slice").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(tops, F.col("user_id").eqNullSafe(F.col("u")) & F.col("slice").eqNullSafe(F.col("s")))
    return joined.select("event_id", "user_id", "step", F.coalesce(F.col("step") > F.greatest("before", F.max("step").over(within)), F.lit(True)).alias("accepted"))


def token_counts(tokens: DataFrame, connections: DataFrame) -> DataFrame:
    counts = connections.groupBy("token_id").agg(F.count("*").alias("connections"))
    return tokens.join(counts, "token_id", "left").select("token_id", F.coalesce("connections", F.lit(0)).alias("connections"))


def push_candidates(pushes: DataFrame, connections: DataFrame) -> DataFrame:
    """Connections that a push concerns: same repository whatever the case, indexed on push, on their branch."""
    wanted = pushes.withColumn("_key", F.lower("full_name")).join(connections.withColumn("_key", F.lower("external_repo")), "_key")
    return wanted.filter(F.col("index_on_push") & (F.col("ref") == F.concat(F.lit("refs/heads/"), F.coalesce("branch", "default_branch")))).drop("_key")
