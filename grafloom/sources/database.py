"""A graph kept in a database file, read through a Python data source.

``spark.read.format("graphfile")`` with the options ``path`` and ``table`` opens the file read-only, checks that
all five tables have their columns, and reads one table in ranges of row numbers, a task each. Comparisons of columns
with values are asked of the file (where the session lets Python sources have filters, which ``read_database`` sees to);
the option ``columns`` names the columns to read, as the engine doesn't tell a Python source which it needs. The file
must be one that all executors reach.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not
from pyspark.sql.types import StructType

from .. import schema as S

RANGE_ROWS = 100_000
_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def asked(f: Filter) -> tuple[str, list] | None:
    """A filter as a condition of the file's own language and its values; None for one that the engine must apply."""
    if isinstance(f, Not):
        inner = asked(f.child)
        return inner and (f"NOT ({inner[0]})", inner[1])
    if len(getattr(f, "attribute", ())) != 1:
        return None
    name = '"' + f.attribute[0].replace('"', '""') + '"'
    if isinstance(f, (IsNull, IsNotNull)):
        return f"{name} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL", []
    if isinstance(f, In):
        return f"{name} IN ({', '.join('?' * len(f.value))})", list(f.value)
    if isinstance(f, EqualNullSafe):
        return f"{name} IS ?", [f.value]
    sign = _COMPARED.get(type(f))
    return (f"{name} {sign} ?", [f.value]) if sign else None


def _open(path: str) -> sqlite3.Connection:
    if not os.path.isfile(path):
        raise FileNotFoundError(f"no database file at {path}")
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    for table, columns in S.TABLES.items():
        present = {r[1] for r in con.execute(f"PRAGMA table_info({table})")}
        missing = [c.split()[0] for c in columns.split(", ") if c.split()[0] not in present]
        if missing:
            con.close()
            raise ValueError(f"`{table}` in {path} " + (f"is missing columns: {', '.join(missing)}" if present else "does not exist"))
    return con


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], rows: int):
        self.path, self.table, self.columns, self.rows = path, table, columns, rows
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            told = asked(f)
            if told is None or not all(isinstance(v, (str, int, float, type(None))) for v in told[1]):
                yield f
            else:
                self.where.append(told)

    def partitions(self) -> list[InputPartition]:
        con = _open(self.path)
        try:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
        finally:
            con.close()
        return [_Range(0, 0)] if low is None else [_Range(a, min(a + self.rows, high + 1)) for a in range(low, high + 1, self.rows)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        con = _open(self.path)
        try:
            more = "".join(f" AND {text}" for text, _ in self.where)
            values = [v for _, own in self.where for v in own]
            yield from con.execute(f"SELECT {', '.join(self.columns)} FROM {self.table} WHERE rowid >= ? AND rowid < ?{more}", (partition.low, partition.high, *values))
        finally:
            con.close()


class GraphFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "graphfile"

    def schema(self) -> str:
        every = S.TABLES[self.options["table"]].split(", ")
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        unknown = set(wanted) - {c.split()[0] for c in every}
        if unknown:
            raise ValueError(f"no such columns: {sorted(unknown)}")
        return ", ".join(c for c in every if not wanted or c.split()[0] in wanted)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["table"], schema.names, int(self.options.get("rows", RANGE_ROWS)))


def read_database(spark: SparkSession, path: str, rows: int = RANGE_ROWS, columns: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """The five tables of a database file, checked before anything is read; of the tables in ``columns`` those columns."""
    _open(path).close()
    spark.dataSource.register(GraphFile)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = lambda t: spark.read.format("graphfile").option("path", path).option("table", t).option("rows", rows).option("columns", ",".join((columns or {}).get(t, [])))
    return {t: reader(t).load() for t in S.TABLES}
