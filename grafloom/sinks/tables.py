"""Keyed tables in a folder: merges and deletes that return their rows, one commit for all tables that they touch.

A table is dealt to ``BUCKETS`` by a hash of the columns that its changes are told apart by; a bucket is one part. A merge
reads and writes the buckets of its rows and commits them with compare-and-set (``commits``): two writers that touch one
bucket are put one behind the other, the second one's change being computed anew on what the first left.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.references import Reference, deleted
from .commits import CommitLog

BUCKETS = 8


@dataclass(frozen=True)
class Table:
    """schema: DDL; key: what a row is known by; spread: the columns that deal its rows to buckets."""

    schema: str
    key: tuple[str, ...]
    spread: tuple[str, ...]


class KeyedTables:
    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table], references: list[Reference] = ()):
        self.spark, self.root, self.tables, self.references = spark, root.rstrip("/"), tables, list(references)
        self.log = CommitLog(spark, self.root)

    def read(self, name: str, state: dict | None = None, buckets: set[int] | None = None) -> DataFrame:
        """A table's rows, or those of some buckets."""
        state = self.log.state()[1] if state is None else state
        paths = [f"{self.root}/{p}" for k, p in sorted(state.items()) if k.startswith(f"{name}/") and (buckets is None or int(k.split("/")[1]) in buckets)]
        schema = self.tables[name].schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, name: str):
        return F.pmod(F.xxhash64(*self.tables[name].spread), F.lit(BUCKETS)).cast("int")

    def _typed(self, name: str, rows: DataFrame) -> DataFrame:
        want = self.spark.createDataFrame([], self.tables[name].schema).schema
        return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in want))

    def stage(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows of a table written aside, so that they are computed once."""
        path = f"{self.root}/_aside/{name}-{uuid.uuid4().hex}"
        self._typed(name, rows).write.parquet(path)
        return self.spark.read.schema(self.tables[name].schema).parquet(path)

    def _parts(self, name: str, state: dict, put: DataFrame | None, gone: DataFrame | None) -> dict[str, str | None]:
        """New parts of the buckets that hold the rows to put (by key) or to take out; the keys of the log."""
        key = list(self.tables[name].key)
        ends = [df.select(self._bucket(name).alias("bucket")) for df in (put, gone) if df is not None]
        touched = {r["bucket"] for df in ends for r in df.distinct().collect()}
        if not touched:
            return {}
        rows = self.read(name, state, touched)
        for df in (put, gone):
            if df is not None:
                rows = rows.join(df.select(*key).distinct(), key, "left_anti")
        rows = rows.select(*self._typed(name, rows).columns)
        if put is not None:
            rows = rows.unionByName(put)
        folder = f"_parts/{name}-{uuid.uuid4().hex}"
        rows.withColumn("bucket", self._bucket(name)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        # A bucket without rows has no folder; any other is kept under its number.
        left = {int(s.getPath().getName()[7:]) for s in self.log._fs.listStatus(self.log._path(f"{self.root}/{folder}")) if s.getPath().getName().startswith("bucket=")}
        return {f"{name}/{b}": f"{folder}/bucket={b}" if b in left else None for b in touched}

    def update(self, change: Callable[[dict[str, DataFrame]], dict[str, tuple[DataFrame | None, DataFrame | None]]]) -> dict[str, tuple[DataFrame | None, DataFrame | None]]:
        """``change`` sees the tables and returns, by name, rows to put in by key and rows to take out; both come back as
        they were committed, of all tables at once. It is called anew if another writer was faster."""

        def make(_: int, state: dict) -> tuple[dict, dict]:
            wanted = change(_Lazy(lambda n: self.read(n, state)))
            fixed = {n: tuple(df if df is None else self.stage(n, df) for df in pair) for n, pair in wanted.items()}
            parts = {k: p for n, (put, gone) in fixed.items() for k, p in self._parts(n, state, put, gone).items()}
            return parts, fixed

        return self.log.transact(make)

    def put(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows in place of those with the same key."""
        return self.update(lambda _: {name: (rows, None)})[name][0]

    def delete(self, name: str, where: Column) -> dict[str, DataFrame]:
        """Takes out the rows of a condition, and in the same commit what refers to them goes or is set null; the rows that
        went, by table."""

        def change(tables: dict[str, DataFrame]) -> dict:
            out = deleted({n: tables[n] for n in self.tables}, self.references, {name: where})
            return {n: (out.changed.get(n), out.gone.get(n)) for n in self.tables if n in out.changed or n in out.gone}

        return {n: gone for n, (_, gone) in self.update(change).items() if gone is not None}

    def set_last(self, name: str, last: int) -> None:
        """What a table's ids go on from, after rows with ids of their own came in."""
        self.log.transact(lambda _, state: ({f"#{name}": max(last, state.get(f"#{name}", 0))}, None))

    def reserve(self, name: str, count: int) -> int:
        """The first of ``count`` new ids of a table; ids that aren't used are left out for good."""
        key = f"#{name}"
        return self.log.transact(lambda _, state: ({key: state.get(key, 0) + count}, state.get(key, 0) + 1)) if count else 0


class _Lazy(dict):
    """Tables that are read when they are asked for."""

    def __init__(self, read: Callable[[str], DataFrame]):
        super().__init__()
        self._read = read

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self._read(name)
        return self[name]
