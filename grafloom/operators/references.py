"""Declared references between tables: deletes that cascade or set columns null, and checks of what is left.

A reference may have several columns; one of them null refers to nothing. Tables must not refer to each other in a ring.
Each reference is one left join on its columns with the distinct keys of the rows that go.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reference:
    """``child.columns`` refer to ``parent.to``. When the parent's row goes, the child's goes too (``cascade``), has
    ``cleared`` set null (``clear``; all columns if none is named), or forbids it (``forbid``)."""

    child: str
    columns: tuple[str, ...]
    parent: str
    to: tuple[str, ...]
    action: str = "cascade"
    cleared: tuple[str, ...] = ()


class ForbiddenDelete(ValueError):
    """A delete that a reference forbids."""


@dataclass
class Deletion:
    """gone: rows that go, by table; changed: rows with columns set null, by table; left: tables after it."""

    gone: dict[str, DataFrame] = field(default_factory=dict)
    changed: dict[str, DataFrame] = field(default_factory=dict)
    left: dict[str, DataFrame] = field(default_factory=dict)


def in_order(names: list[str], references: list[Reference]) -> list[str]:
    """Tables with those that they refer to before them."""
    out: list[str] = []
    while len(out) < len(names):
        ready = [n for n in names if n not in out and all(r.parent in out or r.parent == n or r.parent not in names for r in references if r.child == n)]
        if not ready:
            raise ValueError(f"tables refer to each other in a ring: {sorted(set(names) - set(out))}")
        out += ready
    return out


def _marked(child: DataFrame, r: Reference, parents: DataFrame, mark: str) -> DataFrame:
    """``child`` with a column that tells whether it refers to one of ``parents``."""
    names = [f"{mark}_{i}" for i in range(len(r.to))]
    keys = parents.select(*(F.col(c).alias(n) for c, n in zip(r.to, names, strict=True))).distinct().withColumn(mark, F.lit(True))
    joined = child.join(keys, [F.col(c) == F.col(n) for c, n in zip(r.columns, names, strict=True)], "left")
    return joined.withColumn(mark, F.coalesce(mark, F.lit(False))).drop(*names)


def deleted(tables: dict[str, DataFrame], references: list[Reference], doomed: dict[str, Column]) -> Deletion:
    """What becomes of the tables when the rows that meet a condition, by table, go."""
    out = Deletion(left=dict(tables))
    for name in in_order(list(tables), references):
        columns, own = tables[name].columns, [r for r in references if r.child == name and r.parent in out.gone]
        if not own and name not in doomed:
            continue
        rows = tables[name].withColumn("__gone", F.coalesce(doomed[name], F.lit(False)) if name in doomed else F.lit(False))
        for i, r in enumerate(own):
            rows = _marked(rows, r, out.gone[r.parent], f"__{i}")
        of = {kind: [(f"__{i}", r) for i, r in enumerate(own) if r.action == kind] for kind in ("cascade", "clear", "forbid")}
        lost = reduce(or_, (F.col(m) for m, _ in of["cascade"]), F.col("__gone"))
        if name in doomed or of["cascade"]:
            out.gone[name] = rows.filter(lost).select(*columns)
        rest = rows.filter(~lost)
        for mark, r in of["forbid"]:
            if kept := rest.filter(mark).select(*r.columns).first():
                raise ForbiddenDelete(f"{name} {kept.asDict()} still refers to {r.parent}")
        if of["clear"]:
            hit = {c: [F.col(m) for m, r in of["clear"] if c in (r.cleared or r.columns)] for c in columns}
            put = [F.when(~reduce(or_, hit[c]), F.col(c)).alias(c) if hit[c] else F.col(c) for c in columns]
            cleared = rest.select(*put, reduce(or_, (F.col(m) for m, _ in of["clear"])).alias("__hit"))
            out.changed[name], rest = cleared.filter("__hit").select(*columns), cleared
        out.left[name] = rest.select(*columns)
    return out


def orphans(tables: dict[str, DataFrame], references: list[Reference]) -> DataFrame:
    """(child, parent, reference, row): rows that refer to what isn't there; ``row`` is JSON of the columns that refer."""
    found = None
    for r in references:
        child = tables[r.child].select(*r.columns).filter(" and ".join(f"`{c}` is not null" for c in r.columns))
        bad = _marked(child, r, tables[r.parent], "__0").filter("not __0").select(F.lit(r.child).alias("child"), F.lit(r.parent).alias("parent"), F.lit(",".join(r.columns)).alias("reference"), F.to_json(F.struct(*r.columns)).alias("row"))
        found = bad if found is None else found.unionByName(bad)
    return found


def duplicates(rows: DataFrame, keys: list[str], where: str | None = None) -> DataFrame:
    """Keys that more than one row has, nulls aside, among the rows of a condition."""
    rows = rows.filter(where) if where else rows
    return rows.filter(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
