import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from grafloom.functions import scalars as X
from grafloom.operators import graph as G
from grafloom.operators import resolve as R
from grafloom.operators import trace as T
from grafloom.schema import EDGES, IMPORTS, NODES
from grafloom.sources import adapters as A


def test_patterns():
    assert [X.like_pattern(p) for p in ("", "run", "get_*", "a?c", "50%")] == ["%", "%run%", r"get\_%", "a_c", r"%50\%%"]


def test_scalars(spark):
    rows = spark.createDataFrame([("src/app/util.js",), ("index.js",), ("pkg/__init__.py",), ("a/b.html",)], "p string")
    assert [r[0] for r in rows.select(X.file_qname(F.col("p"))).collect()] == ["src.app.util", "index", "pkg", "a/b.html"]
    refs = spark.createDataFrame([("a/b.html", "../c.css?x"), ("a/b.html", "../../c"), ("a/b.html", "/s/./x.js#q"), ("a", "")], "f string, r string")
    assert [r[0] for r in refs.select(X.resolve_path(F.col("f"), F.col("r"))).collect()] == ["c.css", None, "s/x.js", None]


def sample(spark):
    nodes = spark.createDataFrame([
        ("r", "File", "utils", "pkg.utils", "pkg/utils.py", 1, 9, None), ("r", "Function", "helper", "pkg.utils.helper", "pkg/utils.py", 1, 2, None),
        ("r", "Class", "Base", "pkg.utils.Base", "pkg/utils.py", 3, 9, None), ("r", "Method", "greet", "pkg.utils.Base.greet", "pkg/utils.py", 4, 5, None),
        ("r", "File", "core", "pkg.core", "pkg/core.py", 1, 9, None), ("r", "Class", "Widget", "pkg.core.Widget", "pkg/core.py", 1, 9, None),
        ("r", "Method", "run", "pkg.core.Widget.run", "pkg/core.py", 2, 5, None), ("r", "Method", "stop", "pkg.core.Widget.stop", "pkg/core.py", 6, 7, None),
    ], NODES)
    raw = [("CALLS", "pkg.core.Widget.run", "helper"), ("CALLS", "pkg.core.Widget.run", "self.stop.deeper"), ("CALLS", "pkg.core.Widget.run", "x.greet"), ("CALLS", "pkg.core.Widget.run", "nowhere"), ("INHERITS", "pkg.core.Widget", "Base"), ("CALLS", "pkg.core.Widget.run", "Widget")]
    edges = spark.createDataFrame([("r", t, s, d, d, "pkg/core.py", 0) for t, s, d in raw], EDGES)
    imports = spark.createDataFrame([("r", "pkg/core.py", "helper", "pkg.utils.helper", "symbol")], IMPORTS)
    return nodes, edges, imports


def test_cascade(spark):
    nodes, edges, imports = sample(spark)
    done = {(r.dst_raw): (r.dst_qname, r.rule) for r in R.resolve_edges(edges, nodes, imports).collect()}
    assert done == {"helper": ("pkg.utils.helper", "import_map"), "self.stop.deeper": ("pkg.core.Widget.stop", "enclosing"), "x.greet": ("pkg.utils.Base.greet", "unique_name"), "nowhere": ("nowhere", None), "Base": ("pkg.utils.Base", "unique_name"), "Widget": ("pkg.core.Widget", "same_module")}
    resolved = R.resolve_edges(edges, nodes, imports).drop("rule")
    assert [r.qualified_name for r in G.get_callers(nodes, resolved, "pkg.utils.helper").collect()] == ["pkg.core.Widget.run"]
    assert {r.callee for r in G.get_callees(nodes, resolved, "pkg.core.Widget.run").collect()} == {"pkg.utils.helper", "pkg.core.Widget.stop", "pkg.utils.Base.greet", "nowhere", "pkg.core.Widget"}


def odd_graph():
    """Rows of (nodes, edges, imports) with names of every shape, twice the same, empty or missing."""
    rnd = random.Random(5)
    roots = ["", "a", "a.b", "c", "d.e.f", ".x", None]
    word = lambda: rnd.choice(["f", "g", "h", "K", "self", "", "near"])
    name = lambda: None if rnd.random() < 0.04 else ".".join(p for p in [rnd.choice(roots), *(word() for _ in range(rnd.randrange(3)))] if p is not None)
    repo = lambda: rnd.choice(["r", "q", None]) if rnd.random() < 0.1 else "r"
    file = lambda: rnd.choice(["a.py", "b.py", None])
    nodes = []
    for _ in range(150):
        q, kind = name(), rnd.choice(["File", "Class", "Class", "Interface", "Function", "Method", "Config"])
        nodes.append((repo(), kind, rnd.choice([q and q.split(".")[-1], word() + str(rnd.randrange(60)), None]), q, file(), 1, 1, None))
    nodes += rnd.sample(nodes, 20)
    raw = lambda: rnd.choice([word(), word() + str(rnd.randrange(60)), "self." + word(), "this." + word() + "." + word(), "near." + word(), "near.K." + word(), "cls.", name()])
    edges = []
    for _ in range(1500):
        r = raw()
        edges.append((repo(), rnd.choice(["CALLS", "CALLS", "CALLS", "INHERITS", "USES_TYPE", "IMPORTS"]), rnd.choice([name(), nodes[rnd.randrange(150)][3]]), rnd.choice([r, name()]), r, file(), 0))
    edges += rnd.sample(edges, 100)
    imports = [(repo(), file(), rnd.choice(["near", "near.K", word(), None]), name(), "module") for _ in range(25)]
    return nodes, edges, imports


@pytest.mark.parametrize("held, depths", [(200_000, 8), (200_000, 1), (0, 0)])
def test_cascade_equals_sql(spark, tmp_path, monkeypatch, held, depths):
    """Whether lookups fit a task or not, edges are resolved as SQL has it, copies counted."""
    from grafloom import catalog as C

    monkeypatch.setattr(R, "LOOKUP_ROWS", held, raising=False)
    monkeypatch.setattr(R, "MODULE_DEPTHS", depths, raising=False)
    tables = [spark.createDataFrame(rows, schema).coalesce(1) for rows, schema in zip(odd_graph(), (NODES, EDGES, IMPORTS), strict=True)]
    con = duckdb.connect()
    for df, name in zip(tables, ("s_nodes", "s_raw", "s_imports"), strict=True):
        df.write.parquet(str(tmp_path / name))
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path / name}/*.parquet'")
    want = con.sql(f"WITH {C._PREFIX} SELECT * FROM done")
    got = R.resolve_edges(tables[1], tables[0], tables[2])
    assert got.columns == want.columns
    found = Counter(map(tuple, got.collect()))
    assert found == Counter(want.fetchall()) and {r[7] for r in found} == {None, *R.RULES}


@pytest.mark.parametrize("name", ["resolve_cascade", "resolve_import_map", "resolve_enclosing", "unresolved_edges", "call_degrees"])
def test_edges_are_moved_once(spark, monkeypatch, name):
    """What a shuffle writes of an edge doesn't grow with the rules, and resolved edges aren't written beside the raw ones."""
    from grafloom import catalog as C

    folder, staged = "/root/testdata/sf0.01", []
    raw = C.table(spark, folder, "s_raw")
    edges = raw.count()
    for v in ("s_nodes", "s_imports"):
        C.table(spark, folder, v)
    monkeypatch.setattr(A, "staged", lambda df, label: staged.append(label))
    monkeypatch.setattr(A, "_MADE", {k: v for k, v in A._MADE.items() if k[2] != "s_resolved"})
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = shuffled()
    C._QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    assert not staged and (shuffled() - before) / edges < 110


def plain_trace(neighbours, root, depth):
    seen, total, cut = {root}, 0, False

    def expand(name, level):
        nonlocal total, cut
        kids = []
        if level < depth:
            for nb in sorted(neighbours.get(name, ())):
                if total >= 500 or len(kids) >= 50:
                    cut = True
                    break
                if nb in seen:
                    kids.append((nb, True, []))
                else:
                    seen.add(nb)
                    total += 1
                    kids.append((nb, False, expand(nb, level + 1)))
        return kids

    return expand(root, 0), total, cut


def test_walk_matches_recursion():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(2, 90)
        nb = {str(i): sorted({str(rng.randrange(n)) for _ in range(rng.choice([1, 3, 70]))}) for i in range(n)}
        depth = rng.randint(1, 6)
        tree, total, cut = plain_trace(nb, "0", depth)
        rows, n_seen, cut2 = T.walk("0", {k: v[:51] for k, v in nb.items()}, depth)
        flat = []

        def down(kids, level, flat=flat):
            for name, again, below in kids:
                flat.append((name, level, again))
                down(below, level + 1)

        down(tree, 1)
        assert [(r[2], r[3], r[4]) for r in rows[1:]] == flat and (n_seen, cut2) == (total, cut)


def test_trace_and_direction(spark):
    edges = spark.createDataFrame([("r", "CALLS", a, b, b, "f", 1) for a, b in [("a", "b"), ("b", "c"), ("c", "x"), ("a", "c")]], EDGES)
    assert [(r.qualified_name, r.level, r.is_cycle) for r in T.trace_call_path(edges, "a", depth=2).orderBy("ordinal").collect()] == [("a", 0, False), ("b", 1, False), ("c", 2, False), ("c", 1, True)]
    assert {r[0]: r[1] for r in T.reach(edges, "a", depth=2).collect()} == {"a": 0, "b": 1, "c": 1, "x": 2}
    with pytest.raises(ValueError):
        T.reach(edges, "a", "sideways")


def test_sections_are_cut_and_answers_bounded(spark, monkeypatch):
    """A hot symbol's callers are picked in the tasks, and a list that is too long for the driver is refused."""
    from grafloom.sinks import payload

    nodes = spark.createDataFrame([("r", "Function", f"f{i}", f"m.f{i}", "m.py", i, i, None) for i in range(40)], NODES)
    edges = spark.createDataFrame([("r", "CALLS", f"m.f{i}", "m.f0", "f0", "m.py", 1) for i in range(1, 40)], EDGES)
    imports = spark.createDataFrame([], IMPORTS)
    whole = G.node_context(nodes, edges, imports, "r", "m.f0").first()
    assert len(whole["callers"]) == 39
    monkeypatch.setattr(G._section, "__defaults__", (5,))
    cut = G.node_context(nodes, edges, imports, "r", "m.f0").first()
    assert cut["callers"] == whole["callers"][:5] and cut["siblings"] == whole["siblings"][:5]
    assert len(payload.rows_of(nodes, 40)) == 40
    with pytest.raises(ValueError):
        payload.rows_of(nodes, 39)
    monkeypatch.setattr(payload, "TEXT_ROWS", 10)
    parts = {"nodes": G.payload_nodes(nodes, 100), "links": nodes.limit(0), "repos": nodes.limit(0), "stats": spark.sql("SELECT 8L AS nodes, 3L AS links")}
    with pytest.raises(ValueError):
        payload.payload_json(**parts)


def test_context_is_whole(spark):
    """A file with more imports than one answer to the driver holds."""
    nodes = spark.createDataFrame([("r", "Function", "f", "m.f", "m.py", 1, 1, None)], NODES)
    most = G.SECTION_ROWS + 1
    imports = spark.range(most).selectExpr("'r' AS repo", "'m.py' AS file_path", "'x' || id AS local_name", "'x' || id AS target", "'module' AS kind")
    row = G.node_context(nodes, spark.createDataFrame([], EDGES), imports, "r", "m.f").first()
    assert len(row["dependencies"]) == most and [d["target"] for d in row["dependencies"]] == sorted(f"x{i}" for i in range(most))


def test_payload_resolves_what_it_shows(spark, monkeypatch):
    """The nodes of a view need no edge; its links need the edges that begin at a kept node, and these alone."""
    from grafloom import catalog as C

    folder, met = "/root/testdata/sf0.001", []
    real = C.R.resolve_edges
    monkeypatch.setattr("grafloom.sources.adapters._MADE", {})
    monkeypatch.setattr(C.R, "resolve_edges", lambda edges, *rest: (met.append(edges), real(edges, *rest))[1])
    assert C.explorer_filter(spark, folder).count() and not met
    monkeypatch.setattr(G.payload_nodes, "__defaults__", (150,))
    links = C.graph_payload_links(spark, folder)
    kept = C.table(spark, folder, "s_kept")
    assert met[0].count() < C.table(spark, folder, "s_raw").count() and met[0].join(kept, F.col("id") == F.col("src_qname"), "left_anti").count() == 0
    every = G.payload_links(C._cascade(spark, folder), kept)
    assert sorted(map(tuple, links.collect())) == sorted(map(tuple, every.collect())) != []


def odd_supply(folder):
    """Tables with orders and suppliers of the same key or name, orders and customers without, and hot orders."""
    con = duckdb.connect()
    con.sql("CREATE TABLE region AS SELECT * FROM (VALUES (0, 'R0'), (1, 'R1')) t(r_regionkey, r_name)")
    con.sql("CREATE TABLE nation AS SELECT * FROM (VALUES (0, 'N0', 0), (1, 'N1', 1), (2, NULL, 1), (3, 'N3', 1)) t(n_nationkey, n_name, n_regionkey)")
    con.sql("CREATE TABLE customer AS SELECT CAST(i AS BIGINT) AS c_custkey, CASE WHEN i % 11 = 0 THEN NULL ELSE 'c' || (i % 9) END AS c_name, CAST(i % 4 AS INT) AS c_nationkey FROM range(40) r(i)")
    con.sql("CREATE TABLE supplier AS SELECT CAST(i AS BIGINT) AS s_suppkey, CASE WHEN i % 13 = 0 THEN NULL ELSE 's' || (i % 7) END AS s_name, CAST(i % 4 AS INT) AS s_nationkey FROM range(30) r(i)")
    con.sql("CREATE TABLE orders AS SELECT CASE WHEN i % 17 = 0 THEN NULL ELSE CAST(i % 200 - 20 AS BIGINT) END AS o_orderkey, CAST((i * 7 + i // 200) % 40 AS BIGINT) AS o_custkey FROM range(600) r(i)")
    con.sql("INSERT INTO orders SELECT * FROM orders WHERE o_orderkey % 5 = 0")
    con.sql("CREATE TABLE lineitem AS SELECT CASE WHEN i % 3 = 0 THEN 50 ELSE CAST(i % 210 - 22 AS BIGINT) END AS l_orderkey, CAST(i % 31 AS BIGINT) AS l_suppkey, CASE WHEN i % 19 > 0 THEN CAST(i % 3 AS INT) END AS l_linenumber FROM range(4000) r(i)")
    for name in ("region", "nation", "customer", "supplier", "orders", "lineitem"):
        con.sql(f"COPY {name} TO '{folder}/{name}.parquet'")
    return con


@pytest.mark.parametrize("whole", [False, True])
def test_supply_edges(spark, tmp_path, whole):
    """Raw edges are those of their SQL, copies counted, with names missing or all there."""
    con = odd_supply(tmp_path)
    if whole:
        for table, rule in (("nation", "n_name IS NOT NULL"), ("customer", "c_name IS NOT NULL"), ("orders", "o_orderkey IS NOT NULL")):
            con.sql(f"COPY (SELECT * FROM {table} WHERE {rule}) TO '{tmp_path}/{table}.parquet'")
    for name in ("region", "nation", "customer", "supplier", "orders", "lineitem"):
        con.sql(f"DROP TABLE {name}")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = con.sql(f"{A.cte('s_raw')} SELECT * FROM s_raw")
    got = A.graph(spark, str(tmp_path), "s_raw")
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())


def test_supply_edges_of_a_task(spark, monkeypatch):
    """A task makes distinct no more lines than it is to, however many there are and few partitions a shuffle has."""
    monkeypatch.setattr(A, "TASK_ROWS", 500, raising=False)
    raw = A.graph(spark, "/root/testdata/sf0.001", "s_raw").filter("edge_type = 'CALLS' and dst_raw like 'Supplier%'")
    held = [r["count"] for r in raw.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) > 4000 and max(held) <= 1000
