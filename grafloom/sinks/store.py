"""Graph tables as snapshots: write new parts, then commit their names with compare-and-set.

A store is a folder. Every table of a repository is a list of parts, each a folder that is written once under a name of its
own; the commit log (``commits``) maps ``table/repository`` to that list, with the rows of each part and the least and
greatest file of it, so that a point read opens the parts that may hold the file. A commit names the parts of the
repositories it touches; a reader sees the graph before it or after it, and a failed load leaves the old one. Writers may
work at once: a commit that was derived from what another writer has changed since is made anew, commits to other
repositories are merged. Appending writes the new rows only; ``compact`` joins the parts that piled up. What isn't named
any more is deleted by ``vacuum``.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.scalars import TENANT_SLUG
from .commits import CommitLog, ConflictError

#: Key of each table's upsert, and the column that names a row's repository.
KEYS = {"repos": ["name"], "files": ["repo", "path"], "imports": ["repo", "file_path", "local_name"]}
REPO_COLUMN = {"repos": "name", "nodes": "repo", "edges": "repo", "files": "repo", "imports": "repo"}
FILE_COLUMN = {"nodes": "file_path", "edges": "src_file", "files": "path", "imports": "file_path"}
BATCH = "batch"


class LoadError(RuntimeError):
    """A load that wasn't taken; the store is as it was."""


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows that share ``keys`` the last by ``order``: a partial aggregate, no window."""
    rest = [c for c in rows.columns if c not in keys]
    pick = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(pick.alias("x")).select(*keys, "x.*").select(*rows.columns)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put in place of those with the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def without_files(rows: DataFrame, table: str, files: DataFrame) -> DataFrame:
    """``rows`` of a table less those of the (repo, path) in ``files``."""
    gone = files.select("repo", F.col("path").alias(FILE_COLUMN[table])).distinct()
    return rows.join(gone, ["repo", FILE_COLUMN[table]], "left_anti").select(*rows.columns)


def with_ids(rows: DataFrame, after: int, order: list[str]) -> DataFrame:
    """``rows`` with ``id`` counted on from ``after``: ranks within range partitions plus the rows before them."""
    from ..operators.graph import ranked_by

    return ranked_by(rows, order, "id").withColumn("id", F.col("id") + F.lit(after + 1))


def next_id(rows: DataFrame, column: str = "id") -> Column | int:
    """What a sequence is set to after rows with ids of their own came in: the greatest id, 1 at least."""
    return rows.agg(F.greatest(F.coalesce(F.max(column), F.lit(1)), F.lit(1)).alias("last")).first()["last"]


class GraphStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, self.root)
        self._jvm_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jvm_path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- reading -----------------------------------------------------------
    def version(self) -> int:
        return self.log.state()[0]

    def batch(self) -> int:
        """The last batch that was committed, -1 before the first."""
        return self.log.state()[1].get(BATCH, -1)

    def repos(self) -> list[str]:
        return sorted(_split(k)[1] for k in self.log.state()[1] if k.startswith("repos/"))

    def parts(self, table: str, repo: str | None = None, state: dict | None = None, file: str | None = None) -> list[dict]:
        """The parts of a table, of one repository or all; with a file those that may hold it."""
        state = self.log.state()[1] if state is None else state
        named = [p for k, v in sorted(state.items()) if "/" in k and _split(k)[0] == table and repo in (None, _split(k)[1]) for p in v]
        return [p for p in named if file is None or p["low"] is not None and p["low"] <= file <= p["high"]]

    def read(self, table: str, repo: str | None = None, file: str | None = None, state: dict | None = None) -> DataFrame:
        """A table's rows: all, one repository's, or those of one file; only parts that may hold them are opened."""
        rows = self.of(self.parts(table, repo, state, file), table)
        return rows if file is None else rows.filter(F.col(FILE_COLUMN[table]) == file)

    def of(self, parts: list[dict], table: str) -> DataFrame:
        """The rows of some parts of a table."""
        if not parts:
            return self.spark.createDataFrame([], S.TABLES[table])
        return self.spark.read.schema(S.TABLES[table]).parquet(*(f"{self.root}/{p['path']}" for p in parts))

    def counts(self, exclude: Iterable[str] = ()) -> dict[str, int]:
        """Rows of every table, without the excluded repositories: as noted when they were written."""
        state, gone = self.log.state()[1], set(exclude)
        return {t: sum(p["rows"] for k, v in state.items() if "/" in k and _split(k)[0] == t and _split(k)[1] not in gone for p in v) for t in S.TABLES}

    # -- writing -----------------------------------------------------------
    def write(self, table: str, rows: DataFrame) -> dict:
        """Writes a part that no commit names yet; its rows, and the least and greatest file, are seen on the way."""
        name, told = f"{table}/{uuid.uuid4().hex}", Observation()
        place = F.col(FILE_COLUMN.get(table, REPO_COLUMN[table]))
        seen = self._typed(table, rows).observe(told, F.count(F.lit(1)).alias("rows"), F.min(place).alias("low"), F.max(place).alias("high"))
        seen.write.parquet(f"{self.root}/{name}")
        return {"path": name, **(_told(told) or {"rows": 0, "low": None, "high": None})}

    def write_each(self, table: str, rows: DataFrame, repos: Iterable[str]) -> dict[str, dict]:
        """A part for each of some repositories that has rows; a repository's rows come together, those of a large one in
        several files."""
        names = list(repos)
        if len(names) == 1:
            return {names[0]: self.write(table, rows)}
        folder = f"{table}/{uuid.uuid4().hex}"
        self._typed(table, rows).withColumn("part", F.col(REPO_COLUMN[table])).hint("rebalance", "part").write.partitionBy("part").parquet(f"{self.root}/{folder}")
        return self._written(table, folder)

    def commit(self, repo: str, tables: dict[str, DataFrame | dict], batch: int | None = None, since: int | None = None) -> bool:
        """Puts these tables (rows, or a part from ``write``) in place of one repository's. With a batch number that was
        committed before, nothing. ``since`` is the version that they were derived from: if the repository has been
        changed after it, ConflictError."""
        if batch is not None and batch <= self.batch():
            return False
        return self.commit_all({repo: {t: [rows if isinstance(rows, dict) else self.write(t, rows)] for t, rows in tables.items()}}, batch, since)

    def commit_all(self, repos: dict[str, dict[str, list[dict]]], batch: int | None = None, since: int | None = None) -> bool:
        """Puts parts in place of tables of several repositories, in one commit."""
        parts = {f"{t}/{repo}": own for repo, tables in repos.items() for t, own in tables.items()}

        def make(version: int, state: dict) -> tuple[dict, bool]:
            if batch is not None and batch <= state.get(BATCH, -1):
                return {}, False
            theirs = {_split(k)[1] for k in self.log.changed_since(since)[1] if "/" in k} & set(repos) if since is not None else ()
            if theirs:
                raise ConflictError(f"changed after version {since}: {sorted(theirs)}")
            return parts | ({} if batch is None else {BATCH: batch}), True

        return self.log.transact(make, [f"{t}/{repo}" for t in S.TABLES for repo in repos])

    def append(self, repo: str, table: str, rows: DataFrame) -> None:
        """Adds rows to a table of one repository as a part of their own."""
        part, key = self.write(table, rows), f"{table}/{repo}"
        self.log.transact(lambda _, state: ({key: [*state.get(key, []), part]}, None))

    def upsert(self, repo: str, table: str, rows: DataFrame, order: list[str] | None = None) -> None:
        """Puts rows in place of those with the same key; of new rows with one key the last by ``order`` counts."""
        keys = KEYS[table]
        new = self._typed(table, last_wins(rows, keys, order or [c for c in rows.columns if c not in keys]))
        self._derive(repo, [table], lambda t, old: upserted(old, new, keys))

    def delete_files(self, repo: str, files: DataFrame) -> None:
        """All that came from the given (repo, path)."""
        self._derive(repo, list(FILE_COLUMN), lambda t, old: without_files(old, t, files))

    def compact(self, repo: str, table: str, most: int = 1) -> bool:
        """One part in place of more than ``most``, its files in order, so that their ranges don't overlap."""
        if len(self.parts(table, repo)) <= most:
            return False
        by = FILE_COLUMN.get(table, REPO_COLUMN[table])
        self._derive(repo, [table], lambda t, old: old.repartitionByRange(by).sortWithinPartitions(by))
        return True

    def _derive(self, repo: str, tables: list[str], make) -> None:
        """New parts from the old rows of some tables, made anew if another writer changes them meanwhile."""

        def changes(_: int, state: dict) -> tuple[dict, None]:
            return {f"{t}/{repo}": [self.write(t, make(t, self.read(t, repo, state=state)))] for t in tables}, None

        self.log.transact(changes)

    def mark(self, batch: int) -> None:
        """Notes that a batch was committed, if its own commits haven't."""
        self.log.transact(lambda _, state: ({BATCH: batch} if batch > state.get(BATCH, -1) else {}, None))

    def delete_repo(self, repo: str) -> None:
        self.log.transact(lambda _, state: ({k: None for k in state if "/" in k and _split(k)[1] == repo}, None))

    def load(self, tables: dict[str, DataFrame], replace: bool = False, exclude: Iterable[str] = ()) -> dict[str, int]:
        """All five tables at once, or none. Rows are counted as they are read and, by repository, in what was written."""
        names = {r["name"] for r in tables["repos"].select("name").distinct().collect()}  # a row for each repository
        gone = set(exclude)
        if gone - names:
            raise LoadError(f"can't leave out what isn't there: {sorted(gone - names)}")
        version, state = self.log.state()
        if any("/" in k for k in state) and not replace:
            raise LoadError("there is a graph in this store; ask for it to be replaced")
        told, new = {}, {}
        for table, df in tables.items():
            column, seen, folder = REPO_COLUMN[table], Observation(), f"{table}/{uuid.uuid4().hex}"
            rows = self._typed(table, df).filter(~F.col(column).isin(sorted(gone))).observe(seen, F.count(F.lit(1)).alias("rows"))
            # A repository's rows come together, those of a large one in several files.
            rows.withColumn("part", F.col(column)).hint("rebalance", "part").write.partitionBy("part").parquet(f"{self.root}/{folder}")
            told[table] = (_told(seen) or {"rows": 0})["rows"]
            new |= {f"{table}/{r}": [p] for r, p in self._written(table, folder).items()}
        if not told["nodes"]:
            raise LoadError("nothing to load: no node rows")
        written = self.parity(told, new)
        changes = {k: None for k in state if "/" in k} | new
        if not self.log.commit(version, changes):
            raise LoadError("another writer has changed the store meanwhile")
        return written

    @staticmethod
    def parity(told: dict[str, int], parts: dict[str, list[dict]]) -> dict[str, int]:
        """Rows written of each table, which must be those that were read."""
        written = {t: sum(p["rows"] for k, v in parts.items() if _split(k)[0] == t for p in v) for t in told}
        if written != told:
            raise LoadError(f"rows read and rows written aren't the same: {told}, {written}")
        return written

    def _written(self, table: str, folder: str) -> dict[str, dict]:
        """The part of each repository below a partitioned folder."""
        unescape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        paths = {unescape(n[5:]): n for n in (s.getPath().getName() for s in self._fs.listStatus(self._jvm_path(f"{self.root}/{folder}"))) if n.startswith("part=")}
        if not paths:
            return {}
        rows, place = self.spark.read.schema(S.TABLES[table]).parquet(f"{self.root}/{folder}"), F.col(FILE_COLUMN.get(table, REPO_COLUMN[table]))
        stats = rows.groupBy(F.col(REPO_COLUMN[table]).alias("r")).agg(F.count(F.lit(1)).alias("rows"), F.min(place).alias("low"), F.max(place).alias("high"))
        return {r["r"]: {"path": f"{folder}/{paths[r['r']]}", "rows": r["rows"], "low": r["low"], "high": r["high"]} for r in stats.collect()}

    def vacuum(self, keep_seconds: float = 86_400) -> int:
        """Deletes parts that no commit names and that are older than ``keep_seconds``, which must be longer than any
        writer takes; how many."""
        used = {p["path"].split("/part=")[0] for k, v in self.log.state()[1].items() if "/" in k for p in v}
        gone = 0
        for table in S.TABLES:
            folder = self._jvm_path(f"{self.root}/{table}")
            for status in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                old = status.getModificationTime() <= 1000 * (time.time() - keep_seconds)
                if old and f"{table}/{status.getPath().getName()}" not in used:
                    gone += bool(self._fs.delete(status.getPath(), True))
        return gone

    def _typed(self, table: str, rows: DataFrame) -> DataFrame:
        return rows.selectExpr(*(f"cast(`{c}` as {k}) as `{c}`" for c, k in (x.split() for x in S.TABLES[table].split(", "))))


def _told(seen: Observation) -> dict | None:
    """What was observed; None where the plan was known to be empty and the observation was planned away with it."""
    try:
        return dict(seen.get)
    except Py4JJavaError as e:
        if "assertion failed" in str(e.java_exception):
            return None
        raise


def _split(key: str) -> tuple[str, str]:
    """(table, repository) of a key of the commit log."""
    table, _, repo = key.partition("/")
    return table, repo


def provision(spark: SparkSession, root: str, slug: str) -> GraphStore:
    """The store of a tenant, an empty one if it is new."""
    if not re.fullmatch(TENANT_SLUG[1:-1], slug):
        raise ValueError(f"not a slug: {slug!r}")
    store = GraphStore(spark, f"{root.rstrip('/')}/tenant_{slug}")
    if not store.log.exists():
        store.log.create()
    return store


__all__ = ["GraphStore", "LoadError", "ConflictError", "last_wins", "next_id", "provision", "upserted", "with_ids", "without_files"]
