"""Index and ask: the tools of the engine over a store of graphs and a root of workspaces.

Functions that answer with rows return DataFrames; those of the tool surface return plain dicts and lists, with
wrong arguments answered by ``{"error": ...}`` and nothing raised.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Sequence
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .functions.scalars import REPO_NAME, line_slice
from .jobs import JobLog
from .operators import events as E
from .operators import graph as G
from .operators import resolve as R
from .operators import trace as T
from .operators.extract import Graph, extract
from .plans.staging import staged
from .sinks import payload
from .sinks.store import ConflictError, GraphStore, LoadError, last_wins, without_files
from .sources.database import read_database
from .sources.files import confined, list_trees, preview, read_files, readme_of, text_of


def resolved(graph_nodes: DataFrame, raw_edges: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, imports) of one graph after rooted assets were found and every reference was resolved anew."""
    fixes = staged(R.rooted_assets(imports, graph_nodes), "rooted")
    imports, edges = R.apply_rooted(imports, raw_edges, fixes)
    return R.resolve_edges(edges, graph_nodes, imports).drop("rule"), imports


def snippets(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(repo, qualified_name, kind, file_path, start_line, end_line, signature, code) of nodes whose file's (repo, path,
    text) is at hand."""
    own = texts.select("repo", F.col("path").alias("file_path"), "text")
    return nodes.join(own, ["repo", "file_path"]).select("repo", "qualified_name", "kind", "file_path", "start_line", "end_line", "signature", line_slice(F.col("text"), F.col("start_line"), F.col("end_line")).alias("code"))


def _tally(rows: DataFrame, column: str) -> dict[tuple[str, str], int]:
    """Rows by repository and a column of few values."""
    return {(r["repo"], r[column]): r["count"] for r in rows.groupBy("repo", column).count().collect()}


class CodeGraph:
    def __init__(self, spark: SparkSession, store: GraphStore, workspaces: str):
        self.spark, self.store, self.workspaces = spark, store, workspaces

    # -- indexing ----------------------------------------------------------
    def _folder(self, path: str) -> tuple[str, str]:
        rel = path.strip().lstrip("/\\").replace("\\", "/") or "."
        place = confined(self.workspaces, rel)
        where, base = fs.FileSystem.from_uri(place) if "://" in place else (fs.LocalFileSystem(), place)
        if where.get_file_info(base).type != fs.FileType.Directory:
            raise ValueError(f"no such folder in the workspaces: {rel!r}")
        return rel, place

    def index_repository(self, name: str, path: str) -> dict:
        """Indexes a folder in place of what the store has under this name."""
        return self.index_repositories({name: path})[name]

    def index_repositories(self, folders: dict[str, str]) -> dict[str, dict]:
        """Indexes folders, by name, in one plan and one commit; an answer for each name."""
        out, places = {}, {}
        for name, path in folders.items():
            if not re.fullmatch(REPO_NAME[1:-1], name or ""):
                out[name] = {"error": f"{name!r} can't name a repository: only letters, digits, dot, underscore and hyphen"}
                continue
            try:
                places[name] = self._folder(path)
            except ValueError as e:
                out[name] = {"error": str(e)}
        if places:
            graph = extract(read_files(list_trees(self.spark, {n: place for n, (_, place) in places.items()})))
            tally = _tally(graph.status, "status")
            told = {n: (tally.get((n, "indexed"), 0), sum(k for (repo, status), k in tally.items() if repo == n and status != "indexed"), 0) for n in places}
            out |= self._put({n: rel for n, (rel, _) in places.items()}, graph, None, told, "indexed")
        return out

    def reindex_repository(self, name: str) -> dict:
        """Extracts the files whose hash changed, drops those that are gone, and resolves the repository anew."""
        return self.reindex_repositories([name])[name]

    def reindex_repositories(self, names: Sequence[str]) -> dict[str, dict]:
        """The same for several repositories in one plan and one commit; an answer for each name."""
        version, state = self.store.log.state()
        known = {r["name"]: r["path"] for r in self.store.of([p for n in names for p in self.store.parts("repos", n, state)], "repos").collect()}
        out, places = {}, {}
        for name in names:
            if name not in known:
                out[name] = {"error": f"nothing is indexed as {name!r} yet: use index_repository"}
                continue
            try:
                places[name] = self._folder(known[name])
            except ValueError as e:
                out[name] = {"error": str(e)}
        if places:
            try:
                out |= self._reindex(places, version, state)
            except ConflictError:  # another writer was faster: once more, on what it left
                out |= self._reindex(places, *self.store.log.state())
        return out

    def _old(self, table: str, names: Iterable[str], state: dict) -> DataFrame:
        return self.store.of([p for n in names for p in self.store.parts(table, n, state)], table)

    def _reindex(self, places: dict[str, tuple[str, str]], version: int, state: dict) -> dict[str, dict]:
        listed = staged(list_trees(self.spark, {n: place for n, (_, place) in places.items()}), "listed")
        seen = staged(read_files(listed).select("repo", "path", F.sha2("content", 256).alias("hash")), "seen")
        # A file that can't be read now keeps its rows; one that is no longer listed loses them.
        changes = E.change_set(self._old("files", places, state), seen.filter("hash is not null")).join(seen.filter("hash is null").select("repo", "path"), ["repo", "path"], "left_anti")
        changes = staged(changes.filter("change <> 'same'"), "changes")
        tally = _tally(changes, "change")
        fresh = changes.filter("change <> 'deleted'")
        graph = extract(read_files(listed.join(fresh.select("repo", "path"), ["repo", "path"], "left_semi")))
        skipped = _tally(seen.filter("hash is null").withColumn("state", F.lit("skipped")), "state")
        told = {n: (tally.get((n, "added"), 0) + tally.get((n, "changed"), 0), skipped.get((n, "skipped"), 0), tally.get((n, "deleted"), 0)) for n in places}
        return self._put({n: rel for n, (rel, _) in places.items()}, graph, (changes, version, state), told, "reindexed")

    def _put(self, names: dict[str, str], graph: Graph, onto: tuple[DataFrame, int, dict] | None, told: dict[str, tuple[int, int, int]], status: str) -> dict[str, dict]:
        """Commits the graph of some repositories (name to folder), ``onto`` (changes, version, state) what is kept of the old
        one; ``told`` has for each the files indexed, skipped and deleted. Rows are counted as they are written."""
        key = ["repo", "file_path", "local_name"]
        tables = {"nodes": graph.nodes, "edges": graph.edges, "files": graph.files, "imports": last_wins(graph.imports, key, ["target", "kind"])}
        changes, version, state = onto or (None, None, None)
        if changes is not None:
            tables = {t: without_files(self._old(t, names, state), t, changes).unionByName(df) for t, df in tables.items()}
        parts = {t: self.store.write_each(t, tables[t], names) for t in ("nodes", "files")}
        raw = {t: staged(tables[t], f"index-{t}") for t in ("edges", "imports")}
        nodes = self.store.of(list(parts["nodes"].values()), "nodes")
        for t, df in zip(("edges", "imports"), resolved(nodes, raw["edges"], raw["imports"]), strict=True):
            parts[t] = self.store.write_each(t, df, names)
        when = datetime.now(UTC).isoformat(timespec="seconds")
        size = {n: {t: parts[t][n]["rows"] if n in parts[t] else 0 for t in ("nodes", "edges", "files")} for n in names}
        repos = self.spark.createDataFrame([(n, rel, when, size[n]["nodes"], size[n]["edges"], size[n]["files"]) for n, rel in names.items()], S.REPOS)
        parts["repos"] = self.store.write_each("repos", repos, names)
        self.store.commit_all({n: {t: [found[n]] if n in found else [] for t, found in parts.items()} for n in names}, since=version)
        return {n: {"repo": n, "status": status, "files_indexed": told[n][0], "files_skipped": told[n][1], "files_deleted": told[n][2], "nodes": size[n]["nodes"], "edges": size[n]["edges"]} for n in names}

    def import_database(self, path: str, replace: bool = False, exclude: tuple[str, ...] = (), connections: Sequence[tuple[str, str, str | None]] = (), log: JobLog | None = None, tenant_id: int | None = None) -> dict:
        """Loads a database file's graph into the store, all of it or nothing, then writes the ``connections`` (repository,
        owner/name, commit or None) of the tenant to its job log."""
        if connections and (log is None or tenant_id is None):
            return {"error": "connections need a job log and a tenant"}
        try:
            tables = read_database(self.spark, path)
            told = self.store.load(tables, replace, exclude)
            if connections:
                log.connect(tenant_id, list(connections), set(self.store.repos()))
            return told
        except (LoadError, FileNotFoundError, ValueError) as e:
            return {"error": str(e)}

    # -- reading -----------------------------------------------------------
    def _nodes(self, repo: str | None = None) -> DataFrame:
        return self.store.read("nodes", repo)

    def _edges(self, repo: str | None = None) -> DataFrame:
        return self.store.read("edges", repo)

    def list_repositories(self) -> list[dict]:
        return payload.rows_of(G.list_repositories(self.store.read("repos")))

    def search_symbol(self, pattern: str, repo: str | None = None, limit: int = 100) -> list[dict]:
        return payload.rows_of(G.search_symbol(self._nodes(repo), pattern, repo, limit))

    def get_callers(self, qualified_name: str, repo: str | None = None) -> list[dict]:
        return payload.rows_of(G.get_callers(self._nodes(repo), self._edges(repo), qualified_name, repo))

    def get_callees(self, qualified_name: str, repo: str | None = None) -> list[dict]:
        return payload.rows_of(G.get_callees(self._nodes(repo), self._edges(repo), qualified_name, repo))

    def get_dependencies(self, file_path: str, repo: str | None = None) -> list[dict]:
        return payload.rows_of(G.get_dependencies(self._nodes(repo), self.store.read("imports", repo), file_path, repo))

    def trace_call_path(self, qualified_name: str, direction: str = "callees", depth: int = 3, repo: str | None = None) -> dict:
        try:
            rows = T.trace_call_path(self._edges(repo), qualified_name, direction, depth, repo).collect()
        except ValueError as e:
            return {"error": str(e)}
        return {"root": qualified_name, "direction": direction, "depth": max(1, min(int(depth), S.MAX_DEPTH)), "repo": repo, "nodes_visited": rows[0]["nodes_visited"], "truncated": rows[0]["truncated"], "tree": T.tree_json(rows)}

    def _one_file(self, repo: str, path: str) -> DataFrame:
        """(repo, path, size, content) of one file, confined to the repository's folder; no row if it isn't there."""
        row = self.store.read("repos", repo).first()
        if row is None:
            raise ValueError(f"the store has no repository {repo!r}")
        folder = confined(self.workspaces, row["path"])
        place = confined(folder, path)
        where, base = fs.FileSystem.from_uri(place) if "://" in place else (fs.LocalFileSystem(), place)
        info = where.get_file_info(base)
        if info.type != fs.FileType.File:
            raise ValueError(f"the workspace has no file {path}")
        listed = self.spark.createDataFrame([(repo, folder, os.path.relpath(place, folder).replace(os.sep, "/") if "://" not in place else path, info.size)], "repo string, root string, path string, size long")
        return read_files(listed, max_bytes=1 << 40)

    def get_code_snippet(self, qualified_name: str, repo: str | None = None) -> dict:
        node = G.find_node(self._nodes(repo), qualified_name, repo)
        row = node.first()
        if row is None:
            return {"error": f"unknown symbol: {qualified_name}", "found": False}
        try:
            text = self._one_file(row["repo"], row["file_path"]).select("repo", F.lit(row["file_path"]).alias("path"), text_of(F.col("content")).alias("text"))
        except ValueError as e:
            return {"error": str(e), "found": False}
        return {"found": True} | payload.rows_of(snippets(self.spark.createDataFrame([row], node.schema), text))[0]

    def get_file_source(self, repo: str, path: str) -> dict:
        try:
            row = preview(self._one_file(repo, path)).first().asDict()
        except ValueError as e:
            return {"found": False, "error": str(e)}
        if not row["found"]:
            return {"found": False, "error": row["error"]}
        return {"found": True, "content": row["text"], "bytes": row["bytes"], "truncated": row["truncated"], "line_count": row["line_count"], "repo": repo, "file_path": path}

    def get_repo_readme(self, repo: str) -> dict:
        row = self.store.read("repos", repo).first()
        if row is None:
            return {"found": False, "error": f"nothing is indexed as {repo!r}"}
        try:
            _, place = self._folder(row["path"])
        except ValueError as e:
            return {"found": False, "error": str(e)}
        where, base = fs.FileSystem.from_uri(place) if "://" in place else (fs.LocalFileSystem(), place)
        names = [(repo, e.base_name) for e in where.get_file_info(fs.FileSelector(base)) if e.type == fs.FileType.File]
        best = readme_of(self.spark.createDataFrame(names, "repo string, path string")).first()
        return self.get_file_source(repo, best["path"]) if best else {"found": False, "error": "the top folder holds no README"}

    def get_node_context(self, qualified_name: str, repo: str | None = None) -> dict:
        row = G.find_node(self._nodes(repo), qualified_name, repo).first()
        if row is None:
            return {"found": False, "error": f"unknown symbol: {qualified_name}"}
        own = row["repo"]
        context = payload.rows_of(G.node_context(self._nodes(own), self._edges(own), self.store.read("imports", own), own, qualified_name, section_rows=G.SECTION_ROWS))[0]
        sections = {k: context.pop(k) for k in ("callers", "callees", "dependencies", "dependents", "siblings")}
        context.pop("source")
        return {"found": True, "node": context, "source": self.get_file_source(own, row["file_path"])} | sections

    def graph_payload(self, per_repo: int = S.PAYLOAD_NODES) -> dict[str, DataFrame]:
        """nodes, links, repos and stats; ``payload.write_payload`` or ``payload.payload_json`` put them out."""
        nodes = staged(G.payload_nodes(self._nodes(), per_repo), "payload")
        links = staged(G.payload_links(self._edges(), nodes), "payload")
        return {"nodes": nodes, "links": links, "repos": G.list_repositories(self.store.read("repos")), "stats": G.payload_stats(nodes, links)}


__all__ = ["CodeGraph", "resolved", "snippets"]
