"""Registered queries over the derived graphs, and the same in SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog_control, catalog_files, catalog_jobs
from . import schema as S
from .operators import events as E
from .operators import graph as G
from .operators import resolve as R
from .operators import trace as T
from .operators.extract import html_refs as html_refs_of
from .sources.adapters import cte, table
from .sources.adapters import table as view

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
REPO, NATION = "AFRICA", "NATION_10"


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return _QUERIES | catalog_files.QUERIES | catalog_control.QUERIES | catalog_jobs.QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL | catalog_files.SQL | catalog_control.SQL | catalog_jobs.SQL


def _root(d: DataFrame) -> str:
    """Name of the first part by key: one row, one column read."""
    return d.filter("kind = 'Function'").agg(F.min(F.struct("start_line", "qualified_name"))["qualified_name"]).first()[0]


def _repos(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = view(spark, d, "s_nodes"), view(spark, d, "s_raw")
    files = nodes.filter("kind = 'File'").select("repo")
    return G.repository_counts(nodes, edges, files).select("name", F.concat(F.lit("work/"), "name").alias("path"), F.lit("2024-01-01T00:00:00Z").alias("indexed_at"), *(F.col(c).cast("int").alias(c) for c in ("node_count", "edge_count", "file_count")))


_REPOS = f"""{cte("s_nodes", "s_raw")}, repos AS (
  SELECT n.repo AS name, 'work/' || n.repo AS path, '2024-01-01T00:00:00Z' AS indexed_at, CAST(node_count AS INT) AS node_count, CAST(coalesce(edge_count, 0) AS INT) AS edge_count, CAST(file_count AS INT) AS file_count
  FROM (SELECT repo, count(*) AS node_count, sum(CASE WHEN kind = 'File' THEN 1 ELSE 0 END) AS file_count FROM s_nodes GROUP BY repo) n
  LEFT JOIN (SELECT repo, count(*) AS edge_count FROM s_raw GROUP BY repo) e ON e.repo = n.repo)
"""


@_query(_REPOS + "SELECT * FROM repos")
def list_repositories(spark, d):
    return G.list_repositories(_repos(spark, d))


@_query(_REPOS + "SELECT name, edge_count FROM repos ORDER BY edge_count, name LIMIT 1")
def smallest_repo(spark, d):
    return G.smallest_repo(_repos(spark, d))


def _search_sql(v: str, like: str, limit: int, repo: str | None = None) -> str:
    kinds = ", ".join(f"'{k}'" for k in S.SYMBOL_KINDS)
    own = f" AND repo = '{repo}'" if repo else ""
    return f"{cte(v)} SELECT repo, kind, name, qualified_name, file_path, start_line, signature FROM {v} WHERE kind IN ({kinds}) AND (name ILIKE '{like}' ESCAPE '\\' OR qualified_name ILIKE '{like}' ESCAPE '\\'){own} ORDER BY name, qualified_name, repo, kind, file_path, start_line LIMIT {limit}"


@_query(_search_sql("s_nodes", "%00001%", 100))
def search_symbol_substring(spark, d):
    return G.search_symbol(view(spark, d, "s_nodes"), "00001")


@_query(_search_sql("s_nodes", "SUPPLIER#0000000_1", 1000, REPO))
def search_symbol_glob(spark, d):
    return G.search_symbol(view(spark, d, "s_nodes"), "supplier#0000000?1", REPO, 5000)


_FIRST_PART = "(SELECT qualified_name FROM p_nodes WHERE kind = 'Function' ORDER BY start_line, qualified_name LIMIT 1)"


@_query(f"""{cte("p_nodes", "p_edges")} SELECT DISTINCT n.repo, n.kind, n.qualified_name, n.file_path, n.start_line, n.signature
FROM p_edges e JOIN p_nodes n ON n.repo = e.repo AND n.qualified_name = e.src_qname WHERE e.edge_type = 'CALLS' AND e.resolved = 1 AND e.dst_qname = {_FIRST_PART}""")
def get_callers(spark, d):
    nodes = view(spark, d, "p_nodes")
    return G.get_callers(nodes, view(spark, d, "p_edges"), _root(nodes))


@_query(f"""{cte("p_nodes", "p_edges")} SELECT DISTINCT e.repo, e.dst_qname AS callee, e.resolved = 1 AS resolved, n.kind, n.file_path, n.start_line, n.signature
FROM p_edges e LEFT JOIN p_nodes n ON n.repo = e.repo AND n.qualified_name = e.dst_qname WHERE e.edge_type = 'CALLS' AND e.src_qname = {_FIRST_PART}""")
def get_callees(spark, d):
    nodes = view(spark, d, "p_nodes")
    return G.get_callees(nodes, view(spark, d, "p_edges"), _root(nodes), "parts")


@_query(f"""{cte("s_nodes", "s_imports")} SELECT i.repo, i.local_name, i.target, i.kind, EXISTS(SELECT 1 FROM s_nodes n WHERE n.repo = i.repo AND n.qualified_name = i.target) AS in_project
FROM s_imports i WHERE i.file_path = '{NATION}.py' AND i.repo = '{REPO}'""")
def get_dependencies(spark, d):
    return G.get_dependencies(view(spark, d, "s_nodes"), view(spark, d, "s_imports"), f"{NATION}.py", REPO)


@_query(f"""{cte("s_nodes", "s_raw")} SELECT DISTINCT e.repo, e.src_file AS file_path, e.dst_qname AS imported FROM s_raw e JOIN s_nodes n ON n.repo = e.repo AND n.qualified_name = e.dst_qname
WHERE e.edge_type = 'IMPORTS' AND e.repo = '{REPO}' AND n.file_path = '{NATION}.py' AND e.src_file <> '{NATION}.py' ORDER BY e.src_file, e.dst_qname LIMIT 200""")
def get_dependents(spark, d):
    nodes = view(spark, d, "s_nodes")
    return G.get_dependents(nodes, R.flag_imports(view(spark, d, "s_raw").filter("edge_type = 'IMPORTS'"), nodes), REPO, f"{NATION}.py")


@_query(f"""{cte("s_nodes")} SELECT kind, name, qualified_name, start_line, signature FROM s_nodes WHERE repo = '{REPO}' AND file_path = '{NATION}.py' AND kind <> 'File'
ORDER BY start_line, qualified_name, kind, signature NULLS LAST LIMIT 200""")
def file_symbols(spark, d):
    return G.get_file_symbols(view(spark, d, "s_nodes"), REPO, f"{NATION}.py")


@_query(f"""{cte("s_nodes")}, own AS (SELECT * FROM s_nodes WHERE repo = '{REPO}' AND file_path = '{NATION}.py' AND kind <> 'File')
SELECT kind, name, qualified_name, start_line, signature FROM (SELECT * FROM own ORDER BY start_line, qualified_name, kind, signature NULLS LAST LIMIT 200) x WHERE qualified_name <> (SELECT min(qualified_name) FROM own WHERE start_line = (SELECT min(start_line) FROM own))""")
def file_symbols_excluded(spark, d):
    """The excluded symbol is the first, so that the limit is seen to come before it."""
    nodes = view(spark, d, "s_nodes")
    first = nodes.filter((F.col("repo") == REPO) & (F.col("file_path") == f"{NATION}.py") & (F.col("kind") != "File")).agg(F.min(F.struct("start_line", "qualified_name"))["qualified_name"]).first()[0]
    return G.get_file_symbols(nodes, REPO, f"{NATION}.py", first)


@_query(f"""{cte("s_nodes")} SELECT repo, kind, name, qualified_name, file_path, start_line, end_line, signature FROM s_nodes WHERE qualified_name = '{NATION}' ORDER BY CASE kind WHEN 'File' THEN 1 ELSE 0 END, repo, file_path, start_line, kind LIMIT 1""")
def find_node(spark, d):
    return G.find_node(view(spark, d, "s_nodes"), NATION)


_SECTIONS = {
    "callers": ("repo := repo, kind := kind, qualified_name := qualified_name, file_path := file_path, start_line := start_line, signature := signature", "repo, qualified_name", "SELECT DISTINCT n.repo, n.kind, n.qualified_name, n.file_path, n.start_line, n.signature FROM p_edges e JOIN p_nodes n ON n.qualified_name = e.src_qname WHERE e.edge_type = 'CALLS' AND e.dst_qname = r.q"),
    "callees": ("repo := repo, callee := callee, resolved := resolved, kind := kind, file_path := file_path, start_line := start_line, signature := signature", "callee", "SELECT DISTINCT n.repo, e.dst_qname AS callee, TRUE AS resolved, n.kind, n.file_path, n.start_line, n.signature FROM p_edges e JOIN p_nodes n ON n.qualified_name = e.dst_qname WHERE e.edge_type = 'CALLS' AND e.src_qname = r.q"),
    "dependencies": ("repo := repo, local_name := target, target := target, kind := 'symbol', in_project := TRUE", "target", "SELECT repo, target FROM uses WHERE src_file = r.f"),
    "dependents": ("repo := repo, file_path := src_file, imported := target", "src_file, target", f"SELECT u.repo, u.src_file, u.target FROM uses u JOIN p_nodes n ON n.qualified_name = u.target WHERE n.file_path = r.f AND u.src_file <> r.f ORDER BY u.src_file, u.target LIMIT {S.DEPENDENTS_LIMIT}"),
    "siblings": ("kind := kind, name := name, qualified_name := qualified_name, start_line := start_line, signature := signature", "start_line, qualified_name", f"SELECT * FROM (SELECT kind, name, qualified_name, start_line, signature FROM p_nodes WHERE file_path = r.f AND kind <> 'File' ORDER BY start_line, qualified_name LIMIT {S.SYMBOLS_LIMIT}) s WHERE qualified_name <> r.q"),
}
_CONTEXT = f"""{cte("p_nodes", "p_edges")}, uses AS (SELECT DISTINCT e.repo, e.src_file, e.dst_qname AS target FROM p_edges e JOIN p_nodes n ON n.qualified_name = e.dst_qname WHERE e.edge_type = 'CALLS' AND n.file_path <> e.src_file),
r AS (SELECT *, qualified_name AS q, file_path AS f FROM p_nodes WHERE qualified_name = {_FIRST_PART})
SELECT repo, kind, name, qualified_name, file_path, start_line, end_line, signature,
""" + ",\n".join(f"(SELECT coalesce(CAST(to_json(list(struct_pack({fields}) ORDER BY {order})) AS VARCHAR), '[]') FROM ({rows}) x) AS {name}" for name, (fields, order, rows) in _SECTIONS.items()) + " FROM r"


@_query(_CONTEXT)
def node_context(spark, d):
    """A part with all five sections, each as JSON; a file imports what its parts call in other files."""
    nodes, calls = view(spark, d, "p_nodes"), view(spark, d, "p_edges")
    where = nodes.select(F.col("qualified_name").alias("dst_qname"), F.col("file_path").alias("there"))
    uses = calls.filter("edge_type = 'CALLS'").join(where, "dst_qname").filter("there <> src_file").select("repo", "src_file", "dst_qname").distinct()
    imports = uses.select("repo", F.col("src_file").alias("file_path"), F.col("dst_qname").alias("local_name"), F.col("dst_qname").alias("target"), F.lit("symbol").alias("kind"))
    edges = calls.unionByName(uses.select("repo", F.lit("IMPORTS").alias("edge_type"), F.col("src_file").alias("src_qname"), "dst_qname", F.col("dst_qname").alias("dst_raw"), "src_file", F.lit(1).alias("resolved")))
    told = G.node_context(nodes, edges, imports, "parts", _root(nodes))
    return told.select("repo", "kind", "name", "qualified_name", "file_path", "start_line", "end_line", "signature", *(F.to_json(name, {"ignoreNullFields": "false"}).alias(name) for name in _SECTIONS))


_PREFIX = """
parts AS (SELECT DISTINCT repo, src_qname, string_split(src_qname, '.') AS p FROM s_raw WHERE edge_type <> 'IMPORTS'),
pre AS (SELECT repo, src_qname, n, array_to_string(p[1:n], '.') AS prefix, len(p) AS m FROM (SELECT *, unnest(range(1, len(p) + 1)) AS n FROM parts)),
cls AS (SELECT p.repo, p.src_qname, arg_max(p.prefix, p.n) AS c FROM pre p JOIN (SELECT DISTINCT repo, qualified_name FROM s_nodes WHERE kind IN ('Class', 'Interface')) k ON k.repo = p.repo AND k.qualified_name = p.prefix WHERE p.n < p.m GROUP BY 1, 2),
mod AS (SELECT p.repo, p.src_qname, arg_max(p.prefix, p.n) AS c FROM pre p JOIN (SELECT DISTINCT repo, qualified_name FROM s_nodes WHERE kind = 'File') k ON k.repo = p.repo AND k.qualified_name = p.prefix GROUP BY 1, 2),
q AS (SELECT DISTINCT repo, qualified_name FROM s_nodes),
uc AS (SELECT repo, name, min(qualified_name) AS qn FROM s_nodes WHERE kind IN ('Function', 'Method', 'Class') GROUP BY 1, 2 HAVING count(*) = 1),
ut AS (SELECT repo, name, min(qualified_name) AS qn FROM s_nodes WHERE kind IN ('Class', 'Interface') GROUP BY 1, 2 HAVING count(*) = 1),
im AS (SELECT repo, file_path, local_name, max(target) AS target FROM s_imports GROUP BY 1, 2, 3),
raw AS (SELECT *, string_split(dst_raw, '.') AS dp FROM s_raw WHERE edge_type <> 'IMPORTS'),
cand AS (
  SELECT r.*, CASE WHEN len(dp) = 1 THEN im.target ELSE im.target || '.' || array_to_string(dp[2:], '.') END AS c1,
         CASE WHEN dp[1] IN ('self', 'cls', 'this') AND len(dp) > 1 THEN cls.c || '.' || dp[2] END AS c2,
         CASE WHEN mod.c = '' THEN dp[-1] ELSE mod.c || '.' || dp[-1] END AS c3,
         CASE WHEN edge_type = 'CALLS' THEN uc.qn ELSE ut.qn END AS c4
  FROM raw r LEFT JOIN im ON im.repo = r.repo AND im.file_path = r.src_file AND im.local_name = r.dp[1]
  LEFT JOIN cls ON cls.repo = r.repo AND cls.src_qname = r.src_qname LEFT JOIN mod ON mod.repo = r.repo AND mod.src_qname = r.src_qname
  LEFT JOIN uc ON uc.repo = r.repo AND uc.name = r.dp[-1] LEFT JOIN ut ON ut.repo = r.repo AND ut.name = r.dp[-1]),
hit AS (
  SELECT c.*, CASE WHEN q1.repo IS NOT NULL THEN 'import_map' WHEN q2.repo IS NOT NULL THEN 'enclosing' WHEN q3.repo IS NOT NULL THEN 'same_module' WHEN c4 IS NOT NULL THEN 'unique_name' END AS rule
  FROM cand c LEFT JOIN q q1 ON q1.repo = c.repo AND q1.qualified_name = c1 LEFT JOIN q q2 ON q2.repo = c.repo AND q2.qualified_name = c2 LEFT JOIN q q3 ON q3.repo = c.repo AND q3.qualified_name = c3),
done AS (
  SELECT repo, edge_type, src_qname, CASE rule WHEN 'import_map' THEN c1 WHEN 'enclosing' THEN c2 WHEN 'same_module' THEN c3 WHEN 'unique_name' THEN c4 ELSE dst_raw END AS dst_qname,
         dst_raw, src_file, CASE WHEN rule IS NULL THEN 0 ELSE 1 END AS resolved, rule FROM hit
  UNION ALL
  SELECT s.repo, edge_type, src_qname, dst_qname, dst_raw, src_file, CASE WHEN q.repo IS NULL THEN 0 ELSE 1 END, NULL FROM s_raw s LEFT JOIN q ON q.repo = s.repo AND q.qualified_name = s.dst_qname WHERE edge_type = 'IMPORTS')
"""
_RESOLVED = cte("s_nodes", "s_raw", "s_imports") + "," + _PREFIX


#: Edges or nodes that a task of the resolution holds.
TASK_ROWS = 500_000


def _cascade(spark, d, raw: DataFrame | None = None) -> DataFrame:
    """Raw edges (all, or those given) and nodes are each read several times by the rules: as tables, as a graph holds
    them. What is resolved is not written: it is longer than the raw edges, and made of one move of them."""
    raw, nodes, imports = raw or table(spark, d, "s_raw"), table(spark, d, "s_nodes"), table(spark, d, "s_imports")
    tasks = max(spark.sparkContext.defaultParallelism, -(-max(raw.count(), nodes.count()) // TASK_ROWS))
    return R.resolve_edges(raw, nodes, imports, tasks)


@_query(_RESOLVED + "SELECT * FROM done")
def resolve_cascade(spark, d):
    return _cascade(spark, d)


def _rule(rule: str) -> None:
    def run(spark, d, rule=rule):
        return _cascade(spark, d).filter(F.col("rule") == rule).select("repo", "src_qname", "dst_raw", "dst_qname")

    _QUERIES[f"resolve_{rule}"] = run
    _SQL[f"resolve_{rule}"] = _RESOLVED + f"SELECT repo, src_qname, dst_raw, dst_qname FROM done WHERE rule = '{rule}'"


for _r in R.RULES:
    _rule(_r)


@_query(_RESOLVED + "SELECT repo, edge_type, src_qname, dst_raw FROM done WHERE resolved = 0 AND edge_type <> 'IMPORTS'")
def unresolved_edges(spark, d):
    return R.unresolved(_cascade(spark, d)).select("repo", "edge_type", "src_qname", "dst_raw")


@_query(_RESOLVED + "SELECT repo, qualified_name, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT repo, src_qname AS qualified_name, 1 AS o, 0 AS i FROM done WHERE edge_type = 'CALLS' AND resolved = 1 UNION ALL SELECT repo, dst_qname, 0, 1 FROM done WHERE edge_type = 'CALLS' AND resolved = 1) x GROUP BY 1, 2")
def call_degrees(spark, d):
    return G.degrees(_cascade(spark, d))


@_query(f"""{cte("w_nodes", "w_imports")},
absent AS (SELECT i.*, regexp_replace(regexp_replace(local_name, '^/+', ''), '[?#].*$', '') AS ref FROM w_imports i
  WHERE ((kind = 'asset' AND local_name LIKE '/%') OR kind = 'template') AND NOT EXISTS (SELECT 1 FROM w_nodes n WHERE n.repo = i.repo AND n.qualified_name = i.target)),
ends AS (SELECT repo, qualified_name, array_to_string(p[k:], '/') AS ref FROM (SELECT *, unnest(range(1, len(p) + 1)) AS k FROM (SELECT repo, qualified_name, string_split(file_path, '/') AS p FROM w_nodes WHERE kind = 'File'))),
one AS (SELECT repo, ref, min(qualified_name) AS target_resolved FROM ends GROUP BY 1, 2 HAVING count(*) = 1)
SELECT a.repo, a.file_path, a.local_name, a.target, o.target_resolved FROM absent a JOIN one o ON o.repo = a.repo AND o.ref = a.ref WHERE a.ref <> ''""")
def rooted_assets(spark, d):
    return R.rooted_assets(view(spark, d, "w_imports"), view(spark, d, "w_nodes"))


@_query(f"{cte('w_imports')} SELECT repo, count(*) AS n FROM w_imports WHERE target LIKE 'data:%' GROUP BY repo")
def data_uri_count(spark, d):
    return G.data_uri_count(view(spark, d, "w_imports"))


_PAYLOAD = f"""{cte("s_nodes", "s_raw", "s_imports")},{_PREFIX},
kept AS (SELECT qualified_name AS id, repo, kind, name, file_path, start_line FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY kind, name, qualified_name, file_path, start_line) AS rn FROM s_nodes) z WHERE rn <= 3000),
links AS (SELECT src_qname AS source, dst_qname AS target, edge_type AS type, repo, resolved = 1 AS resolved FROM done WHERE src_qname IN (SELECT id FROM kept) AND dst_qname IN (SELECT id FROM kept))
"""


@_query(_PAYLOAD + "SELECT * FROM kept")
def graph_payload_nodes(spark, d):
    return G.payload_nodes(view(spark, d, "s_nodes"))


def _payload(spark, d) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): a link's source stands in the raw edge, so only edges that begin at a kept node are resolved."""
    kept = table(spark, d, "s_kept", lambda: G.payload_nodes(table(spark, d, "s_nodes")))
    own = view(spark, d, "s_raw").join(kept.select(F.col("id").alias("src_qname")), "src_qname", "left_semi")
    raw = table(spark, d, "s_kept_raw", lambda: own.select(*view(spark, d, "s_raw").columns))
    return kept, G.payload_links(_cascade(spark, d, raw), kept)


@_query(_PAYLOAD + "SELECT * FROM links")
def graph_payload_links(spark, d):
    return _payload(spark, d)[1]


@_query(_PAYLOAD + "SELECT * FROM (SELECT count(*) AS nodes, count(DISTINCT repo) AS repos, count(DISTINCT file_path) AS files FROM kept) a, (SELECT count(*) AS links, count(CASE WHEN type <> 'CONTAINS' THEN 1 END) AS dependencies FROM links) b")
def graph_payload_stats(spark, d):
    return G.payload_stats(*_payload(spark, d))


@_query(_PAYLOAD + f", shown AS (SELECT * FROM kept WHERE repo = '{REPO}' AND kind IN ('Class', 'Method') AND (contains(lower(name), '1') OR contains(lower(id), '1'))) SELECT id, repo, kind, name, file_path, start_line, regexp_split_to_array(id, '[./]')[-1] AS label FROM shown")
def explorer_filter(spark, d):
    return G.explorer_nodes(G.payload_nodes(view(spark, d, "s_nodes")), REPO, ["Class", "Method"], "1")


@_query(_PAYLOAD + f", shown AS (SELECT * FROM kept WHERE repo = '{REPO}' AND kind IN ('Class', 'Method') AND (contains(lower(name), '1') OR contains(lower(id), '1'))) SELECT * FROM links WHERE type = 'CALLS' AND source IN (SELECT id FROM shown) AND target IN (SELECT id FROM shown)")
def explorer_links(spark, d):
    return G.explorer_filter(*_payload(spark, d), REPO, ["Class", "Method"], ["CALLS"], "1")[1]


@_query(f"{cte('p_edges')} SELECT repo, src_qname AS container, count(*) AS members FROM p_edges WHERE edge_type = 'CONTAINS' GROUP BY 1, 2")
def containment_rollup(spark, d):
    return G.containment_rollup(view(spark, d, "p_edges"))


@_query(f"{cte('w_files')} SELECT CASE WHEN instr(file_path, '/') > 0 THEN split_part(file_path, '/', 1) ELSE '(root)' END AS top_dir, count(*) AS n FROM w_files GROUP BY 1 ORDER BY n DESC, top_dir LIMIT 20")
def top_level_dirs(spark, d):
    return G.top_level_dirs(view(spark, d, "w_files").withColumnRenamed("file_path", "path"))


@_query("SELECT 'documents' AS table_name, 'text' AS column_name, source AS repo, count(*) AS n, CAST(max(octet_length(encode(text))) AS BIGINT) AS longest FROM documents WHERE octet_length(encode(text)) > 2000 GROUP BY source")
def oversize_values(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumnRenamed("source", "repo")
    return G.oversize_values({"documents": docs}, [("documents", "text"), ("documents", "lang")])


def _reach_sql(a: str, b: str) -> str:
    return f"""{cte("p_nodes", "p_edges").replace("WITH ", "WITH RECURSIVE ", 1)},
hop(q, depth) AS (SELECT {_FIRST_PART}, 0 UNION SELECT e.{b}, h.depth + 1 FROM hop h JOIN p_edges e ON e.{a} = h.q AND e.edge_type = 'CALLS' AND e.resolved = 1 WHERE h.depth < 3)
SELECT q AS qualified_name, min(depth) AS depth FROM hop GROUP BY q"""


@_query(_reach_sql("src_qname", "dst_qname"))
def reach_callees(spark, d):
    return T.reach(view(spark, d, "p_edges"), _root(view(spark, d, "p_nodes")), "callees", 3, "parts")


@_query(_reach_sql("dst_qname", "src_qname"))
def reach_callers(spark, d):
    return T.reach(view(spark, d, "p_edges"), _root(view(spark, d, "p_nodes")), "callers", 3)


_TRACE = f"""{cte("p_nodes", "p_edges").replace("WITH ", "WITH RECURSIVE ", 1)},
near AS (SELECT a, list(b ORDER BY b)[1:{S.MAX_BREADTH}] AS kids, count(*) > {S.MAX_BREADTH} AS more FROM (SELECT DISTINCT src_qname AS a, dst_qname AS b FROM p_edges WHERE edge_type = 'CALLS' AND resolved = 1) c GROUP BY a),
walk(ordinal, parent, name, level, again, todo, seen, cut) AS (
  SELECT 0, CAST(NULL AS INTEGER), r, 0, FALSE, coalesce(list_transform(kids, lambda k: struct_pack(n := k, p := 0, l := 1)), []), [r], coalesce(more, FALSE) FROM (SELECT {_FIRST_PART} AS r) x LEFT JOIN near ON a = r
  UNION ALL
  SELECT ordinal + 1, head.p, head.n, head.l, known, list_concat(CASE WHEN opens THEN list_transform(kids, lambda k: struct_pack(n := k, p := ordinal + 1, l := head.l + 1)) ELSE [] END, todo[2:]),
         CASE WHEN known THEN seen ELSE list_append(seen, head.n) END, cut OR (opens AND more)
  FROM (SELECT w.*, n.kids, n.more, list_contains(seen, head.n) AS known, NOT list_contains(seen, head.n) AND head.l < 3 AND n.kids IS NOT NULL AS opens
        FROM (SELECT *, todo[1] AS head FROM walk WHERE len(todo) > 0 AND len(seen) <= {S.MAX_TRACE_NODES}) w LEFT JOIN near n ON n.a = w.head.n) y)
SELECT ordinal, parent AS parent_ordinal, name AS qualified_name, level, again AS is_cycle, CAST((SELECT max(len(seen)) - 1 FROM walk) AS INTEGER) AS nodes_visited,
       (SELECT bool_or(cut) OR max(CASE WHEN ordinal = (SELECT max(ordinal) FROM walk) THEN len(todo) END) > 0 FROM walk) AS truncated FROM walk"""


@_query(_TRACE)
def trace_tree(spark, d):
    return T.trace_call_path(view(spark, d, "p_edges"), _root(view(spark, d, "p_nodes")), "callees", 3)


_REFS = r"""SELECT page_id, CAST(k AS INT) AS pos, trim(trim(ref, ''''), '"') AS ref FROM (SELECT page_id, unnest(r) AS ref, unnest(range(len(r))) AS k FROM (
  SELECT page_id, list_filter(flatten(list_transform(regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)(<script\b[^>]*>).*?</script>', '\1', 'g'), '<[A-Za-z](?:"[^"]*"|''[^'']*''|[^''">])*>'),
    lambda t: regexp_extract_all(t, '[\s"''](?:src|href)\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1))),
    lambda x: trim(trim(x, ''''), '"') <> '' AND NOT contains(x, '{{') AND NOT contains(x, '{%') AND NOT lower(trim(trim(x, ''''), '"')) LIKE 'data:%') AS r FROM pages))"""


@_query(_REFS)
def html_refs(spark, d):
    return html_refs_of(spark.read.parquet(f"{d}/pages.parquet"))


@_query("SELECT source AS repo, 'd' || CAST(doc_id AS STRING) AS path, CASE WHEN doc_id % 10 = 0 THEN 'deleted' WHEN doc_id % 10 = 1 THEN 'added' WHEN doc_id % 10 = 2 THEN 'changed' ELSE 'same' END AS change FROM documents")
def change_set(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("source").alias("repo"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), (F.col("doc_id") % 10).alias("m"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    old = docs.filter("m <> 1").select("repo", "path", F.when(F.col("m") == 2, F.lit("other")).otherwise(F.col("hash")).alias("hash"))
    return E.change_set(old, docs.filter("m <> 0").select("repo", "path", "hash"))


@_query(f"{cte('jobs')} SELECT tenant_id, repo_name, id, status, trigger FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, repo_name ORDER BY created_at DESC, id DESC) AS rn FROM jobs) z WHERE rn = 1")
def latest_job(spark, d):
    return E.latest_job(view(spark, d, "jobs"))


@_query(f"{cte('jobs')} SELECT id, tenant_id, repo_name, trigger, status FROM jobs ORDER BY created_at DESC, id DESC LIMIT 25")
def recent_jobs(spark, d):
    return E.recent_jobs(view(spark, d, "jobs"))


@_query(f"{cte('jobs')} SELECT tenant_id, repo_name, min(id) AS id, count(*) AS requests FROM jobs WHERE status = 'queued' GROUP BY 1, 2")
def queued_collapse(spark, d):
    return E.queued_collapse(view(spark, d, "jobs"))


@_query("""WITH RECURSIVE h AS (SELECT user_id AS key, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f(key, k, start, hits) AS (SELECT key, k, t, 1 FROM h WHERE k = 1 UNION ALL SELECT h.key, h.k, CASE WHEN f.start < h.t - 86400000000 THEN h.t ELSE f.start END, CASE WHEN f.start < h.t - 86400000000 THEN 1 ELSE f.hits + 1 END FROM f JOIN h ON h.key = f.key AND h.k = f.k + 1)
SELECT key, start AS window_start, hits FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY k DESC) AS rn FROM f) z WHERE rn = 1""")
def rate_window_fold(spark, d):
    hits = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return E.rate_window_fold(hits, 86_400_000_000)


@_query("SELECT event_id, user_id, step, coalesce(step > max(step) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS accepted FROM (SELECT event_id, user_id, ts, event_id % 1000 AS step FROM events) s")
def replay_guard(spark, d):
    return E.replay_guard(spark.read.parquet(f"{d}/events.parquet").withColumn("step", F.col("event_id") % 1000))


@_query("SELECT c_custkey AS token_id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS connections FROM customer")
def token_counts(spark, d):
    return E.token_counts(spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("token_id")), spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("token_id")))


@_query("SELECT c.c_custkey AS connection_id, n.n_name AS full_name FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE c.c_acctbal > 0 AND c.c_mktsegment IN ('BUILDING', 'MACHINERY')")
def push_candidates(spark, d):
    nation = spark.read.parquet(f"{d}/nation.parquet")
    connections = spark.read.parquet(f"{d}/customer.parquet").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("connection_id"), F.lower("n_name").alias("external_repo"), (F.col("c_acctbal") > 0).alias("index_on_push"), F.when(F.col("c_mktsegment") == "BUILDING", F.lit("main")).when(F.col("c_mktsegment") != "MACHINERY", F.lit("dev")).alias("branch"))
    pushes = nation.select(F.initcap("n_name").alias("full_name"), F.lit("refs/heads/main").alias("ref"), F.lit("main").alias("default_branch"))
    return E.push_candidates(pushes, connections).select("connection_id", F.upper("full_name").alias("full_name"))
