"""Property graphs derived from the star-schema tables, so that every operator has data at any scale.

Each graph is SQL that Spark and other engines read alike; ``graph`` binds it to a folder's tables and
``cte`` hands the same text to a checker.

parts: brands are files, parts functions, and consecutive lines of an order call each other. supply: a
region is a repository; nations are files, customers classes, orders methods and suppliers functions;
orders call the suppliers of their lines by bare name, or through the class, and nations import a
neighbour's suppliers. web: pages are files and their links imports.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import staged

T = TypeVar("T")
_PARTS = {
    "p_nodes": """
  SELECT 'parts' AS repo, 'Function' AS kind, p_name AS name, p_brand || '.p' || CAST(p_partkey AS STRING) AS qualified_name,
         p_brand || '.py' AS file_path, CAST(p_partkey AS INT) AS start_line, CAST(p_partkey + p_size AS INT) AS end_line, 'def ' || p_name AS signature
  FROM part
  UNION ALL
  SELECT DISTINCT 'parts', 'File', p_brand || '.py', p_brand, p_brand || '.py', 1, 1, CAST(NULL AS STRING) FROM part""",
    "p_edges": """
  SELECT DISTINCT 'parts' AS repo, 'CALLS' AS edge_type, a.p_brand || '.p' || CAST(a.p_partkey AS STRING) AS src_qname,
         b.p_brand || '.p' || CAST(b.p_partkey AS STRING) AS dst_qname, b.p_brand || '.p' || CAST(b.p_partkey AS STRING) AS dst_raw, a.p_brand || '.py' AS src_file, 1 AS resolved
  FROM (SELECT l_partkey AS x, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS y FROM lineitem) s
  JOIN part a ON a.p_partkey = s.x JOIN part b ON b.p_partkey = s.y WHERE s.x <> s.y
  UNION ALL
  SELECT 'parts', 'CONTAINS', p_brand, p_brand || '.p' || CAST(p_partkey AS STRING), p_brand || '.p' || CAST(p_partkey AS STRING), p_brand || '.py', 1 FROM part""",
}
_SUPPLY = {
    "s_nodes": """
  SELECT r_name AS repo, 'File' AS kind, n_name || '.py' AS name, n_name AS qualified_name, n_name || '.py' AS file_path, 1 AS start_line, 1 AS end_line, CAST(NULL AS STRING) AS signature
  FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL
  SELECT r_name, 'Class', c_name, n_name || '.' || c_name, n_name || '.py', CAST(c_custkey AS INT), CAST(c_custkey AS INT), 'class ' || c_name
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  UNION ALL
  SELECT r_name, 'Method', 'o' || CAST(o_orderkey AS STRING), n_name || '.' || c_name || '.o' || CAST(o_orderkey AS STRING), n_name || '.py', CAST(o_orderkey AS INT), CAST(o_orderkey AS INT), CAST(NULL AS STRING)
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  UNION ALL
  SELECT r_name, 'Function', s_name, n_name || '.' || s_name, n_name || '.py', CAST(s_suppkey AS INT), CAST(s_suppkey AS INT), 'def ' || s_name
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "s_orders": """
  SELECT r_name AS repo, n_name, c_name, o_orderkey, o_custkey, n_name || '.' || c_name || '.o' || CAST(o_orderkey AS STRING) AS qname
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "s_raw": """
  SELECT DISTINCT o.repo, 'CALLS' AS edge_type, o.qname AS src_qname, s_name AS dst_qname, s_name AS dst_raw, o.n_name || '.py' AS src_file, 0 AS resolved
  FROM lineitem JOIN s_orders o ON o.o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey
  UNION ALL
  SELECT repo, 'CALLS', qname, 'self.o' || CAST(o_orderkey - 1 AS STRING), 'self.o' || CAST(o_orderkey - 1 AS STRING), n_name || '.py', 0 FROM s_orders
  UNION ALL
  SELECT DISTINCT repo, 'CALLS', qname, 'peer.' || 's' || CAST(o_custkey % 7 AS STRING), 'peer.' || 's' || CAST(o_custkey % 7 AS STRING), n_name || '.py', 0 FROM s_orders
  UNION ALL
  SELECT DISTINCT o.repo, 'CALLS', o.qname, 'near.' || s_name, 'near.' || s_name, o.n_name || '.py', 0
  FROM lineitem JOIN s_orders o ON o.o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber = 1
  UNION ALL
  SELECT repo, 'INHERITS', qualified_name, 'Base', 'Base', file_path, 0 FROM s_nodes WHERE kind = 'Class'
  UNION ALL
  SELECT i.repo, 'IMPORTS', i.module, i.target, i.local_name, i.file_path, 0 FROM s_links i""",
    "s_links": """
  SELECT repo, file_path, local_name, target, 'module' AS kind, module FROM (
    SELECT r_name AS repo, a.n_name || '.py' AS file_path, 'near' AS local_name, max(b.n_name) AS target, a.n_name AS module
    FROM nation a JOIN region ON r_regionkey = a.n_regionkey JOIN nation b ON b.n_regionkey = a.n_regionkey AND b.n_nationkey < a.n_nationkey GROUP BY r_name, a.n_name
    UNION ALL
    SELECT r_name, n_name || '.py', 'react', 'react', n_name FROM nation JOIN region ON r_regionkey = n_regionkey
    UNION ALL
    SELECT r_name, a.n_name || '.py', 'own_' || s_name, b.n_name || '.' || s_name, a.n_name
    FROM nation a JOIN region ON r_regionkey = a.n_regionkey JOIN nation b ON b.n_regionkey = a.n_regionkey AND b.n_nationkey <> a.n_nationkey JOIN supplier ON s_nationkey = b.n_nationkey) x""",
    "s_imports": "SELECT repo, file_path, local_name, target, kind FROM s_links",
}
_WEB = {
    "w_files": r"""
  SELECT 'web' AS repo, regexp_replace(url, '^[a-z]+://[^/]+/?', '') || '/index.html' AS file_path, page_id FROM pages""",
    "w_nodes": """
  SELECT repo, 'File' AS kind, file_path AS name, file_path AS qualified_name, file_path, 1 AS start_line, 1 AS end_line, CAST(NULL AS STRING) AS signature FROM w_files
  UNION ALL
  SELECT 'web', 'File', 'site' || CAST(page_id AS STRING), 'www/' || CAST(page_id % 97 AS STRING) || '/p' || CAST(page_id AS STRING), 'www/' || CAST(page_id % 97 AS STRING) || '/p' || CAST(page_id AS STRING), 1, 1, CAST(NULL AS STRING) FROM pages""",
    "w_imports": """
  SELECT DISTINCT 'web' AS repo, f.file_path, '/p' || CAST(g.page_id AS STRING) || CASE WHEN g.page_id % 3 = 0 THEN '?v=1' ELSE '' END AS local_name,
         'p' || CAST(g.page_id AS STRING) AS target, CASE WHEN g.page_id % 5 = 0 THEN 'external' ELSE 'asset' END AS kind
  FROM (SELECT file_path, page_id + 1 AS other FROM w_files UNION ALL SELECT file_path, page_id * 2 FROM w_files) f JOIN pages g ON g.page_id = f.other
  UNION ALL
  SELECT 'web', file_path, 'logo', 'data:image/png;base64,' || CAST(page_id AS STRING), 'asset' FROM w_files WHERE page_id % 4 = 0""",
}
#: A tree of files in every format, eight for each part and two that they share: (path, text).
_TREE = {
    "x_files": r"""
  SELECT 'tree' AS repo, path, text FROM (
    SELECT 'src/m' || k || '.py' AS path, 'import os' || nl || 'from .m' || n || ' import f' || n || ' as g' || nl || nl || nl || 'class C' || k || '(Base):' || nl || '    def run(self):' || nl || '        return g(self.x())' || nl || nl || nl || 'def f' || k || '():' || nl || '    return C' || k || '()' || nl AS text FROM x_keys
    UNION ALL
    SELECT 'web/n' || k || '.js', 'import { h' || n || ' as b } from ''./n' || n || '.js'';' || nl || 'export function h' || k || '() { return b(); }' || nl || 'const z' || k || ' = () => h' || k || '();' || nl FROM x_keys
    UNION ALL
    SELECT 'site/p' || k || '.html', '<a href="/docs/d' || k || '"><img src=''../img/i' || r || '.png?v=1''><link href=css/s' || r || '.css><!-- <a href="/no"> --><script src="https://cdn.example/x.js">var a = 1; "<a href=''/inner''>"</script><a href="#top"><a href="data:x"><a href="/docs/d' || k || '">' FROM x_keys
    UNION ALL
    SELECT 'css/c' || k || '.css', '/* @import "no.css"; */ @import url(base' || r || '.css); @import "../theme.css";' FROM x_keys
    UNION ALL
    SELECT 'pkg/k' || k || '/package.json', '{"name": "p", "dependencies": {"react": "1", "lib' || r || '": "2"}, "devDependencies": {"react": "3", "dev_' || r || '": "1"}}' FROM x_keys
    UNION ALL
    SELECT 'tpl/t' || k || '.html', '{% extends "tpl/base.html" %}' || nl || '{% from "tpl/macros.html" import field as fld, other with context %}' || nl || '{% macro own' || k || '(a) %}{{ fld(a) }}{% endmacro %}{{ url_for("x") }}{{ own' || k || '(1) }}' FROM x_keys
    UNION ALL
    SELECT 'ops/o' || k || '/compose.yml', 'services:' || nl || '  web' || k || ':' || nl || '    image: x' || nl || '    depends_on:' || nl || '      - db' || nl || '  db:' || nl || '    image: y' || nl FROM x_keys
    UNION ALL
    SELECT 'cfg/a' || k || CASE WHEN q = 0 THEN '.txt' WHEN q = 1 THEN '.bad.py' ELSE '.ini' END, CASE WHEN q = 1 THEN 'def (' ELSE 'a = 1' END FROM x_keys
    UNION ALL
    SELECT 'src/base.py', 'class Base:' || nl || '    pass' || nl FROM x_keys WHERE k = '1'
    UNION ALL
    SELECT 'tpl/macros.html', '{% macro field(a) %}{% endmacro %}' FROM x_keys WHERE k = '1') t""",
    "x_keys": r"""
  SELECT CAST(p_partkey AS STRING) AS k, CAST(p_partkey + 1 AS STRING) AS n, CAST(p_partkey % 3 AS STRING) AS r, p_partkey % 3 AS q, '
' AS nl, p_partkey AS partkey FROM part""",
}
_JOBS = {
    "jobs": """
  SELECT event_id AS id, user_id % 5 AS tenant_id, 'r' || CAST(user_id AS STRING) AS repo_name, event_type AS trigger, ts AS created_at,
         CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'succeeded' ELSE 'failed' END AS status FROM events""",
}
GRAPHS = {"parts": _PARTS, "supply": _SUPPLY, "web": _WEB, "tree": _TREE, "jobs": _JOBS}
#: Views in the order in which they can be made.
ORDER = ["p_nodes", "p_edges", "s_nodes", "s_orders", "s_links", "s_imports", "s_raw", "w_files", "w_nodes", "w_imports", "x_keys", "x_files", "jobs"]
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages"]


@cache
def _needs(view: str) -> tuple[str, ...]:
    """Views that a view reads, itself last, in order."""
    text = next(g[view] for g in GRAPHS.values() if view in g)
    below = [v for v in ORDER if v != view and re.search(rf"\b{v}\b", text)]
    return tuple(v for v in ORDER if v == view or any(v in _needs(b) for b in below))


def cte(*views: str) -> str:
    """``WITH`` clause that defines the views and what they read."""
    need = [v for v in ORDER if any(v in _needs(x) for x in views)]
    every = {k: v for g in GRAPHS.values() for k, v in g.items()}
    return "WITH " + ",\n".join(f"{v} AS ({every[v]})" for v in need)


def graph(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """One view of a folder's tables."""
    if view == "s_raw":
        return _supply_edges(spark, sf_dir)
    return _bound(spark, sf_dir, f"{cte(view)}\nSELECT * FROM {view}", deal=view in _TREE)


def _bound(spark: SparkSession, sf_dir: str, text: str, deal: bool = False) -> DataFrame:
    """A statement over a folder's tables, bound as arguments so that no session-wide names are made."""
    text = text.replace("{", "{{").replace("}", "}}")
    used = [t for t in TABLES if re.search(rf"(?:FROM|JOIN) {t}\b", text)]
    for t in used:
        text = re.sub(rf"(FROM|JOIN) {t}\b(?! AS)", rf"\1 {{{t}}}", text)
    text = re.sub(r"(?<!\{)\{(\w+)\} ([ab]|g) ", r"{\1} AS \2 ", text)
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    if deal:
        # A few bytes of a key make eight files to parse: keys are dealt to all cores, whatever the table's size in bytes.
        read["part"] = read["part"].select("p_partkey").repartition(2 * spark.sparkContext.defaultParallelism, "p_partkey")
    return spark.sql(text, **read)


#: Lines of orders that a task makes distinct.
TASK_ROWS = 250_000


def _supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``s_raw``: what its text makes distinct is made so here, order by order, and the rest runs as it is written.

    A source's name ends in its order's key, so calls that are the same belong to one order: keys of lines and orders
    are dealt to as many tasks as their number asks for, and a call is told from others by the order's key and the
    supplier's name before any longer text is made. Only sources without a name may be the same across orders.
    """
    orders, customers, nations, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "nation", "lineitem"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-lines.count() // TASK_ROWS), -(-orders.count() // TASK_ROWS))
    nameless = any(not t.filter(F.col(c).isNull()).isEmpty() for t, c in ((orders, "o_orderkey"), (customers, "c_name"), (nations, "n_name")))
    source = ["o_orderkey", "repo", "n_name", "qname"]

    def calls(rows: DataFrame, targets: Column) -> DataFrame:
        """The edges of each source to its array of targets, one branch of the text for each place in it."""
        out = rows.select("repo", "qname", "n_name", F.posexplode(targets).alias("branch", "to"))
        if nameless:
            out = out.filter("qname is not null").unionByName(out.filter("qname is null").distinct())
        return out.select("repo", F.lit("CALLS").alias("edge_type"), F.col("qname").alias("src_qname"), F.col("to").alias("dst_qname"), F.col("to").alias("dst_raw"), F.concat("n_name", F.lit(".py")).alias("src_file"), F.lit(0).alias("resolved"))

    known = graph(spark, sf_dir, "s_orders")
    peers = known.select(*source, (F.col("o_custkey") % 7).alias("s")).repartition(tasks, "o_orderkey").distinct()
    sources = known.select(*source).repartition(tasks, "o_orderkey").distinct()
    lines = lines.select("l_orderkey", "l_suppkey", (F.col("l_linenumber") == 1).alias("first")).repartition(tasks, "l_orderkey")
    named = lines.join(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name"), F.col("s_suppkey") == F.col("l_suppkey"))
    called = named.groupBy("l_orderkey", "s_name").agg(F.coalesce(F.max("first"), F.lit(False)).alias("first"))
    met = called.join(sources, F.col("o_orderkey") == F.col("l_orderkey"))
    out = calls(met, F.when(F.col("first"), F.array("s_name", F.concat(F.lit("near."), "s_name"))).otherwise(F.array("s_name")))
    out = out.union(calls(peers, F.array(F.concat(F.lit("peer.s"), F.col("s").cast("string")))))
    plain = "UNION ALL".join(b for b in _SUPPLY["s_raw"].split("UNION ALL") if "DISTINCT" not in b)
    return out.union(_bound(spark, sf_dir, f"{cte('s_nodes', 's_orders', 's_links')}\n{plain}"))


_MADE: dict[tuple, object] = {}


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """What tells a folder's tables from an earlier state of them: sizes and times of change."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)))


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], T]) -> T:
    """What ``make`` gives, made once for a session and state of the folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name, _stamp(spark, sf_dir))
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def table(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame] | None = None) -> DataFrame:
    """A view (or what ``make`` gives) as a table of its own, written once for a session and state of the folder, as a
    graph store holds its tables; queries then read columns and rows of it."""
    return once(spark, sf_dir, name, lambda: staged(make() if make else graph(spark, sf_dir, name), name))
