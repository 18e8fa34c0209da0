"""Registered queries over files: extraction of every format, resolution of what it found, text reads, indexing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import resolved, snippets
from .operators import events as E
from .operators import extract as X
from .operators.table_function import register_functions
from .operators import graph as G
from .sinks import store
from .sources import files as files_of
from .sources.adapters import cte, once, table
from .sources.adapters import graph as view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _files(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "x_files").select("repo", "path", F.octet_length("text").cast("long").alias("size"), F.col("text").cast("binary").alias("content"))


def _graph(spark: SparkSession, d: str) -> X.Graph:
    """The tree's graph: the files are parsed once, each query reads what it needs of that."""
    return once(spark, d, "x_graph", lambda: X.extract(_files(spark, d)))


def _resolved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g = _graph(spark, d)
    return resolved(*(table(spark, d, f"x_{name}", lambda name=name: getattr(g, name)) for name in ("nodes", "edges", "imports")))


#: What the tree's files hold, from the keys that they were made of.
_NODES = """nodes AS (
  SELECT 'File' AS kind, 'm' || k AS name, 'src.m' || k AS qualified_name, 'src/m' || k || '.py' AS file_path, 1 AS start_line, 12 AS end_line, CAST(NULL AS VARCHAR) AS signature FROM x_keys
  UNION ALL SELECT 'Class', 'C' || k, 'src.m' || k || '.C' || k, 'src/m' || k || '.py', 5, 7, 'class C' || k || '(Base)' FROM x_keys
  UNION ALL SELECT 'Method', 'run', 'src.m' || k || '.C' || k || '.run', 'src/m' || k || '.py', 6, 7, 'def run(self)' FROM x_keys
  UNION ALL SELECT 'Function', 'f' || k, 'src.m' || k || '.f' || k, 'src/m' || k || '.py', 10, 11, 'def f' || k || '()' FROM x_keys
  UNION ALL SELECT 'File', 'n' || k, 'web.n' || k, 'web/n' || k || '.js', 1, 4, NULL FROM x_keys
  UNION ALL SELECT 'Function', 'h' || k, 'web.n' || k || '.h' || k, 'web/n' || k || '.js', 2, 2, 'function h' || k || '()' FROM x_keys
  UNION ALL SELECT 'Function', 'z' || k, 'web.n' || k || '.z' || k, 'web/n' || k || '.js', 3, 3, 'const z' || k || '()' FROM x_keys
  UNION ALL SELECT 'File', 'p' || k || '.html', 'site/p' || k || '.html', 'site/p' || k || '.html', 1, 1, NULL FROM x_keys
  UNION ALL SELECT 'File', 'c' || k || '.css', 'css/c' || k || '.css', 'css/c' || k || '.css', 1, 1, NULL FROM x_keys
  UNION ALL SELECT 'Config', 'package.json', 'pkg/k' || k || '/package.json', 'pkg/k' || k || '/package.json', 1, 1, NULL FROM x_keys
  UNION ALL SELECT 'File', 't' || k || '.html', 'tpl/t' || k || '.html', 'tpl/t' || k || '.html', 1, 3, NULL FROM x_keys
  UNION ALL SELECT 'Function', 'own' || k, 'tpl/t' || k || '.html.own' || k, 'tpl/t' || k || '.html', 3, 3, 'macro own' || k FROM x_keys
  UNION ALL SELECT 'Config', 'compose.yml', 'ops/o' || k || '/compose.yml', 'ops/o' || k || '/compose.yml', 1, 8, NULL FROM x_keys
  UNION ALL SELECT 'Service', 'web' || k, 'ops/o' || k || '/compose.yml::web' || k, 'ops/o' || k || '/compose.yml', 2, 5, NULL FROM x_keys
  UNION ALL SELECT 'Service', 'db', 'ops/o' || k || '/compose.yml::db', 'ops/o' || k || '/compose.yml', 6, 7, NULL FROM x_keys
  UNION ALL SELECT 'Config', 'a' || k || '.ini', 'cfg/a' || k || '.ini', 'cfg/a' || k || '.ini', 1, 1, NULL FROM x_keys WHERE q = 2
  UNION ALL SELECT * FROM (VALUES ('File', 'base', 'src.base', 'src/base.py', 1, 3, NULL), ('Class', 'Base', 'src.base.Base', 'src/base.py', 1, 2, 'class Base'),
    ('File', 'macros.html', 'tpl/macros.html', 'tpl/macros.html', 1, 1, NULL), ('Function', 'field', 'tpl/macros.html.field', 'tpl/macros.html', 1, 1, 'macro field')) v)"""
#: raw: what extraction gives as the target; final: what resolution makes of it; ``nx``: whether there is a next key.
_EDGES = """last AS (SELECT *, partkey < max(partkey) OVER () AS nx FROM x_keys),
edges AS (
  SELECT 'IMPORTS' AS edge_type, 'src.m' || k AS src_qname, 'os' AS raw_dst, 'os' AS dst_raw, 'src/m' || k || '.py' AS src_file, 'os' AS final, 0 AS done FROM last
  UNION ALL SELECT 'IMPORTS', 'src.m' || k, 'src.m' || n || '.f' || n, 'g', 'src/m' || k || '.py', 'src.m' || n || '.f' || n, CAST(nx AS INT) FROM last
  UNION ALL SELECT 'CONTAINS', 'src.m' || k, 'src.m' || k || '.C' || k, 'src.m' || k || '.C' || k, 'src/m' || k || '.py', 'src.m' || k || '.C' || k, 1 FROM last
  UNION ALL SELECT 'INHERITS', 'src.m' || k || '.C' || k, 'Base', 'Base', 'src/m' || k || '.py', 'src.base.Base', 1 FROM last
  UNION ALL SELECT 'CONTAINS', 'src.m' || k || '.C' || k, 'src.m' || k || '.C' || k || '.run', 'src.m' || k || '.C' || k || '.run', 'src/m' || k || '.py', 'src.m' || k || '.C' || k || '.run', 1 FROM last
  UNION ALL SELECT 'CALLS', 'src.m' || k || '.C' || k || '.run', 'g', 'g', 'src/m' || k || '.py', CASE WHEN nx THEN 'src.m' || n || '.f' || n ELSE 'g' END, CAST(nx AS INT) FROM last
  UNION ALL SELECT 'CALLS', 'src.m' || k || '.C' || k || '.run', 'self.x', 'self.x', 'src/m' || k || '.py', 'self.x', 0 FROM last
  UNION ALL SELECT 'CONTAINS', 'src.m' || k, 'src.m' || k || '.f' || k, 'src.m' || k || '.f' || k, 'src/m' || k || '.py', 'src.m' || k || '.f' || k, 1 FROM last
  UNION ALL SELECT 'CALLS', 'src.m' || k || '.f' || k, 'C' || k, 'C' || k, 'src/m' || k || '.py', 'src.m' || k || '.C' || k, 1 FROM last
  UNION ALL SELECT 'IMPORTS', 'web.n' || k, 'web.n' || n || '.h' || n, 'b', 'web/n' || k || '.js', 'web.n' || n || '.h' || n, CAST(nx AS INT) FROM last
  UNION ALL SELECT 'CONTAINS', 'web.n' || k, 'web.n' || k || '.h' || k, 'web.n' || k || '.h' || k, 'web/n' || k || '.js', 'web.n' || k || '.h' || k, 1 FROM last
  UNION ALL SELECT 'CALLS', 'web.n' || k || '.h' || k, 'b', 'b', 'web/n' || k || '.js', CASE WHEN nx THEN 'web.n' || n || '.h' || n ELSE 'b' END, CAST(nx AS INT) FROM last
  UNION ALL SELECT 'CONTAINS', 'web.n' || k, 'web.n' || k || '.z' || k, 'web.n' || k || '.z' || k, 'web/n' || k || '.js', 'web.n' || k || '.z' || k, 1 FROM last
  UNION ALL SELECT 'CALLS', 'web.n' || k || '.z' || k, 'h' || k, 'h' || k, 'web/n' || k || '.js', 'web.n' || k || '.h' || k, 1 FROM last
  UNION ALL SELECT 'IMPORTS', 'site/p' || k || '.html', x.dst, x.raw, 'site/p' || k || '.html', x.dst, 0 FROM last, LATERAL (VALUES ('docs/d' || k, '/docs/d' || k), ('img/i' || r || '.png', '../img/i' || r || '.png?v=1'), ('site/css/s' || r || '.css', 'css/s' || r || '.css'), ('https://cdn.example/x.js', 'https://cdn.example/x.js')) x(dst, raw)
  UNION ALL SELECT 'IMPORTS', 'css/c' || k || '.css', x.dst, x.raw, 'css/c' || k || '.css', x.dst, 0 FROM last, LATERAL (VALUES ('css/base' || r || '.css', 'base' || r || '.css'), ('theme.css', '../theme.css')) x(dst, raw)
  UNION ALL SELECT 'IMPORTS', 'pkg/k' || k || '/package.json', x.dst, x.dst, 'pkg/k' || k || '/package.json', x.dst, 0 FROM last, LATERAL (VALUES ('react'), ('lib' || r), ('dev_' || r)) x(dst)
  UNION ALL SELECT 'CONTAINS', 'tpl/t' || k || '.html', 'tpl/t' || k || '.html.own' || k, 'tpl/t' || k || '.html.own' || k, 'tpl/t' || k || '.html', 'tpl/t' || k || '.html.own' || k, 1 FROM last
  UNION ALL SELECT 'CALLS', 'tpl/t' || k || '.html', 'fld', 'fld', 'tpl/t' || k || '.html', 'fld', 0 FROM last
  UNION ALL SELECT 'CALLS', 'tpl/t' || k || '.html', 'own' || k, 'own' || k, 'tpl/t' || k || '.html', 'tpl/t' || k || '.html.own' || k, 1 FROM last
  UNION ALL SELECT 'IMPORTS', 'tpl/t' || k || '.html', 'tpl/tpl/base.html', 'tpl/base.html', 'tpl/t' || k || '.html', 'tpl/tpl/base.html', 0 FROM last
  UNION ALL SELECT 'IMPORTS', 'tpl/t' || k || '.html', 'tpl/tpl/macros.html', 'tpl/macros.html', 'tpl/t' || k || '.html', 'tpl/macros.html', 1 FROM last
  UNION ALL SELECT 'CONTAINS', 'ops/o' || k || '/compose.yml', 'ops/o' || k || '/compose.yml::' || x.s, 'ops/o' || k || '/compose.yml::' || x.s, 'ops/o' || k || '/compose.yml', 'ops/o' || k || '/compose.yml::' || x.s, 1 FROM last, LATERAL (VALUES ('web' || k), ('db')) x(s)
  UNION ALL SELECT 'IMPORTS', 'ops/o' || k || '/compose.yml::web' || k, 'ops/o' || k || '/compose.yml::db', 'db', 'ops/o' || k || '/compose.yml', 'ops/o' || k || '/compose.yml::db', 1 FROM last
  UNION ALL SELECT * FROM (VALUES ('CONTAINS', 'src.base', 'src.base.Base', 'src.base.Base', 'src/base.py', 'src.base.Base', 1), ('CONTAINS', 'tpl/macros.html', 'tpl/macros.html.field', 'tpl/macros.html.field', 'tpl/macros.html', 'tpl/macros.html.field', 1)) v)"""
_HEAD = cte("x_keys")


@_query(f"{_HEAD}, {_NODES} SELECT 'tree' AS repo, * FROM nodes")
def extract_nodes(spark, d):
    return _graph(spark, d).nodes


@_query(f"{_HEAD}, {_NODES} SELECT * FROM nodes")
def extracted_nodes(spark, d):
    """The nodes of a tree by the table function of SQL, in one statement."""
    register_functions(spark)
    texts = _files(spark, d).select("path", F.col("content").cast("string").alias("text"))
    return spark.sql("SELECT n.* FROM {texts} f, LATERAL extracted('nodes', f.path, f.text) n", texts=texts)


@_query(f"{_HEAD}, {_EDGES} SELECT 'tree' AS repo, edge_type, src_qname, raw_dst AS dst_qname, dst_raw, src_file, CASE edge_type WHEN 'CONTAINS' THEN 1 ELSE 0 END AS resolved FROM edges")
def extract_edges(spark, d):
    return _graph(spark, d).edges


@_query(f"""{_HEAD}, {_EDGES} SELECT 'tree' AS repo, src_file AS file_path, CASE WHEN src_file LIKE 'ops/%' THEN regexp_extract(src_qname, '::(.*)$', 1) || '->' || dst_raw ELSE dst_raw END AS local_name, raw_dst AS target,
CASE WHEN src_file LIKE 'ops/%' THEN 'service' WHEN src_file LIKE 'pkg/%' OR dst_raw LIKE 'https:%' THEN 'external' WHEN src_file LIKE 'tpl/%' THEN 'template' WHEN src_file LIKE 'site/%' OR src_file LIKE 'css/%' THEN 'asset' WHEN dst_raw = 'os' THEN 'module' ELSE 'symbol' END AS kind FROM edges WHERE edge_type = 'IMPORTS'""")
def extract_imports(spark, d):
    return _graph(spark, d).imports


@_query(f"{cte('x_files')} SELECT repo, path, CASE WHEN path LIKE '%.bad.py' THEN 'failed' ELSE 'indexed' END AS status FROM x_files WHERE path NOT LIKE '%.txt'")
def extract_status(spark, d):
    return _graph(spark, d).status


@_query(f"{cte('x_files')} SELECT repo, path, sha256(text) AS hash FROM x_files WHERE path NOT LIKE '%.txt' AND path NOT LIKE '%.bad.py'")
def extract_files(spark, d):
    return _graph(spark, d).files


@_query(f"{_HEAD}, {_EDGES} SELECT 'tree' AS repo, edge_type, src_qname, final AS dst_qname, dst_raw, src_file, done AS resolved FROM edges")
def index_resolved(spark, d):
    return _resolved(spark, d)[0]


@_query(f"{_HEAD}, {_EDGES} SELECT 'tree' AS repo, src_file AS file_path, dst_raw AS local_name, final AS target FROM edges WHERE src_file LIKE 'tpl/%' AND edge_type = 'IMPORTS'")
def index_rewritten_imports(spark, d):
    return _resolved(spark, d)[1].filter("kind = 'template'").select("repo", "file_path", "local_name", "target")


@_query(f"{_HEAD}, {_NODES} SELECT 'tree' AS repo, kind, name, qualified_name, file_path, start_line, signature FROM nodes WHERE kind <> 'File' AND (name ILIKE 'own_' OR qualified_name ILIKE 'own_' OR name ILIKE '%1/%::db' OR qualified_name ILIKE '%1/%::db' OR name ILIKE '%n1.z1' OR qualified_name ILIKE '%n1.z1') ORDER BY name, qualified_name LIMIT 1000")
def search_symbol_wildcards(spark, d):
    nodes = _graph(spark, d).nodes
    both = [G.search_symbol(nodes, p, limit=1000) for p in ("own?", "*1/*::db", "*N1.Z1")]
    return both[0].unionByName(both[1]).unionByName(both[2]).orderBy("name", "qualified_name").limit(1000)


@_query(f"{_HEAD}, {_EDGES} SELECT DISTINCT 'tree' AS repo, dst_raw AS package FROM edges WHERE dst_raw LIKE '%\\_%' ESCAPE '\\' AND src_file LIKE 'pkg/%'")
def search_symbol_escaped(spark, d):
    """The escape is proved by names with an underscore among names without."""
    named = _graph(spark, d).imports.filter("kind = 'external'").select("repo", F.lit("Config").alias("kind"), F.col("local_name").alias("name"), F.col("local_name").alias("qualified_name"), F.lit("p").alias("file_path"), F.lit(1).alias("start_line"), F.lit(None).cast("string").alias("signature")).distinct()
    return G.search_symbol(named, "_").select("repo", F.col("name").alias("package"))


@_query(f"""{cte("x_files")}, {cte("x_keys").removeprefix("WITH ").replace("x_keys AS", "unused AS", 1)}, {_NODES.replace("x_keys", "unused")}
SELECT n.file_path, n.qualified_name, n.kind, n.start_line, n.end_line, n.signature, 'tree' AS repo, array_to_string(list_slice(string_split(rtrim(f.text, chr(10)), chr(10)), n.start_line, n.end_line), chr(10)) AS code
FROM nodes n JOIN x_files f ON f.path = n.file_path WHERE n.kind IN ('Class', 'Method', 'Function', 'Service')""")
def code_snippets(spark, d):
    return snippets(_graph(spark, d).nodes.filter(F.col("kind").isin("Class", "Method", "Function", "Service")), view(spark, d, "x_files"))


@_query("""SELECT 'docs' AS repo, 'd' || doc_id AS path, TRUE AS found, CAST(NULL AS VARCHAR) AS error, octet_length(encode(text)) AS bytes, octet_length(encode(text)) > 1000 AS truncated,
CASE WHEN octet_length(encode(text)) > 1000 THEN -1 WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS line_count FROM documents WHERE text IS NOT NULL""")
def file_previews(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("text is not null")
    rows = files_of.preview(docs.select(F.lit("docs").alias("repo"), F.concat(F.lit("d"), "doc_id").alias("path"), F.col("text").cast("binary").alias("content")), 1000)
    return rows.select("repo", "path", "found", "error", "bytes", "truncated", F.when(F.col("truncated"), -1).otherwise(F.col("line_count")).cast("long").alias("line_count"))


@_query("SELECT 'r' || (doc_id % 50) AS repo, CASE WHEN bool_or(doc_id % 7 = 0) THEN 'README.md' WHEN bool_or(doc_id % 7 = 1) THEN 'readme.RST' ELSE 'Readme' END AS path FROM documents WHERE doc_id % 7 IN (0, 1, 2) GROUP BY 1")
def readme_lookup(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    name = F.element_at(F.array(*map(F.lit, ["README.md", "readme.RST", "Readme", "readmes.md", "docs/readme.md", "read.me", "x"])), (F.col("doc_id") % 7 + 1).cast("int"))
    return files_of.readme_of(docs.select(F.concat(F.lit("r"), (F.col("doc_id") % 50).cast("string")).alias("repo"), name.alias("path")))


@_query("SELECT user_id AS k, max(event_id) AS v FROM events GROUP BY user_id")
def upsert_last_wins(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("k"), F.col("event_id").alias("v"))
    old = rows.filter("v % 2 = 0")
    return store.upserted(store.last_wins(old, ["k"], ["v"]), store.last_wins(rows, ["k"], ["v"]), ["k"])


@_query(f"{cte('x_files')} SELECT 'tree' AS repo, path, sha256(text) AS hash FROM x_files WHERE path NOT LIKE '%.txt' AND path NOT LIKE '%.bad.py' AND path NOT LIKE 'web/%'")
def delete_file_rows(spark, d):
    g = _graph(spark, d)
    return store.without_files(g.files, "files", g.files.filter("path like 'web/%'").select("repo", "path"))


@_query("SELECT event_id, 100 + row_number() OVER (ORDER BY ts, event_id) AS id FROM events")
def id_sequence(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("ts", "event_id")
    return store.with_ids(rows, 100, ["ts", "event_id"]).select("event_id", "id")


@_query("SELECT greatest(coalesce(max(event_id), 1), 1) AS last FROM events")
def sequence_value(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    return rows.agg(F.greatest(F.coalesce(F.max("event_id"), F.lit(1)), F.lit(1)).alias("last"))


@_query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS p, count(*) OVER () AS n FROM events) x WHERE p % greatest(1, n // 100) = 0")
def systematic_sample(spark, d):
    return G.systematic_sample(spark.read.parquet(f"{d}/events.parquet").select("ts", "event_id"), ["ts", "event_id"], 100).select("event_id")


@_query("SELECT change, count(*) AS n FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN 'deleted' WHEN doc_id % 10 = 1 THEN 'added' WHEN doc_id % 10 = 2 THEN 'changed' ELSE 'same' END AS change FROM documents) x GROUP BY change")
def run_counters(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.lit("r").alias("repo"), F.col("doc_id").cast("string").alias("path"), (F.col("doc_id") % 10).alias("m"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    old = docs.filter("m <> 1").select("repo", "path", F.when(F.col("m") == 2, F.lit("other")).otherwise(F.col("hash")).alias("hash"))
    return E.change_set(old, docs.filter("m <> 0").select("repo", "path", "hash")).groupBy("change").agg(F.count("*").alias("n"))


__all__ = ["QUERIES", "SQL"]
