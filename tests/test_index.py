"""Indexing end to end, re-indexing, the store, sinks and sources."""

import json
import os
import sqlite3
import tarfile
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from grafloom import schema as S
from grafloom.api import CodeGraph
from grafloom.operators import extract as X
from grafloom.operators import graph as G
from grafloom.operators.table_function import register_functions
from grafloom.sinks import payload
from grafloom.sinks.commits import CommitLog
from grafloom.sinks.store import ConflictError, GraphStore, LoadError, last_wins, next_id, provision, with_ids
from grafloom.sources import database, files
from tests.test_jobs import log_at

SAMPLE = {
    "pkg/__init__.py": "",
    "pkg/utils.py": "def helper():\n    return 1\n\n\nclass Base:\n    def greet(self):\n        return helper()\n",
    "pkg/core.py": "from .utils import Base, helper\n\n\nclass Widget(Base):\n    def run(self):\n        helper()\n        return self.greet_twice()\n\n    def greet_twice(self):\n        return self.greet()\n\n\ndef build():\n    return Widget()\n",
    "app.py": "from pkg.core import Widget, build\n\n\ndef main():\n    return build()\n\n\ndef make():\n    return Widget()\n\n\ndef orphan():\n    return does_not_exist()\n",
}


def put(root, tree):
    for path, text in tree.items():
        os.makedirs(os.path.dirname(f"{root}/{path}") or str(root), exist_ok=True)
        with open(f"{root}/{path}", "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())


@pytest.fixture
def code(spark, tmp_path):
    put(tmp_path / "work" / "sample", SAMPLE)
    return CodeGraph(spark, GraphStore(spark, f"file://{tmp_path}/store"), str(tmp_path / "work"))


def test_full_index(code):
    done = code.index_repository("sample", "sample")
    assert (done["status"], done["files_indexed"], done["files_skipped"], done["files_deleted"]) == ("indexed", 4, 0, 0)
    assert [r["file_count"] for r in code.list_repositories()] == [4] and code.list_repositories()[0]["node_count"] == done["nodes"]
    assert {r["qualified_name"] for r in code.get_callers("pkg.utils.helper")} == {"pkg.core.Widget.run", "pkg.utils.Base.greet"}
    edges = {(r.edge_type, r.src_qname, r.dst_qname, r.resolved) for r in code.store.read("edges", "sample").collect()}
    assert ("INHERITS", "pkg.core.Widget", "pkg.utils.Base", 1) in edges
    assert ("CALLS", "app.orphan", "does_not_exist", 0) in edges
    assert ("CALLS", "app.main", "pkg.core.build", 1) in edges
    assert {r["target"] for r in code.get_dependencies("app.py") if r["in_project"]} == {"pkg.core.build", "pkg.core.Widget"}
    tree = code.trace_call_path("app.main", depth=4)
    assert tree["tree"]["children"][0]["qualified_name"] == "pkg.core.build" and not tree["truncated"]
    assert "error" in code.trace_call_path("app.main", "sideways") and "error" in code.index_repository("bad name", "sample")
    assert "error" in code.index_repository("x", "../..") and "error" in code.index_repository("x", "absent")


def test_reindex(code, tmp_path):
    root = tmp_path / "work" / "sample"
    code.index_repository("sample", "sample")
    same = code.reindex_repository("sample")
    assert (same["files_indexed"], same["files_deleted"], same["status"]) == (0, 0, "reindexed")
    put(root, {"extra.py": "from pkg.utils import helper\n\n\ndef more():\n    return helper()\n"})
    added = code.reindex_repository("sample")
    assert (added["files_indexed"], added["files_deleted"]) == (1, 0)
    assert "extra.more" in {r["qualified_name"] for r in code.get_callers("pkg.utils.helper")}
    os.remove(root / "extra.py")
    gone = code.reindex_repository("sample")
    assert (gone["files_indexed"], gone["files_deleted"], gone["nodes"], gone["edges"]) == (0, 1, same["nodes"], same["edges"])
    put(root, {"pkg/utils.py": "def helper():\n    return 2\n"})
    less = code.reindex_repository("sample")
    assert less["files_indexed"] == 1
    inherits = code.store.read("edges").filter("edge_type = 'INHERITS'").collect()
    assert [(r.dst_qname, r.resolved) for r in inherits] == [("Base", 0)]
    put(root, {"pkg/utils.py": "x" * 3, "broken.py": "def ("})
    broken = code.reindex_repository("sample")
    assert broken["files_indexed"] == 2 and code.store.read("files").filter("path = 'broken.py'").count() == 0
    put(root, {"app.py": "#" * (S.MAX_FILE_BYTES + 1)})
    large = code.reindex_repository("sample")
    assert large["files_skipped"] == 1 and code.store.read("files").filter("path = 'app.py'").count() == 1
    assert "error" in code.reindex_repository("absent")


def test_rooted_assets_are_rewritten(spark, tmp_path):
    put(tmp_path / "w" / "r", {"webapp/app/templates/base.html": '<script src="/static/app.js"></script><a href="/static/x.js">', "webapp/app/static/app.js": "function f() {}\n", "a/static/x.js": "", "b/static/x.js": ""})
    code = CodeGraph(spark, GraphStore(spark, f"file://{tmp_path}/s"), str(tmp_path / "w"))
    code.index_repository("r", "r")
    edges = {(r.dst_raw, r.dst_qname, r.resolved) for r in code.store.read("edges").filter("edge_type = 'IMPORTS'").collect()}
    assert ("/static/app.js", "webapp.app.static.app", 1) in edges
    deps = {r["local_name"]: r for r in code.get_dependencies("webapp/app/templates/base.html")}
    assert deps["/static/app.js"]["in_project"] and not deps["/static/x.js"]["in_project"]


def test_source_reads(code, tmp_path):
    code.index_repository("sample", "sample")
    root = tmp_path / "work" / "sample"
    got = code.get_code_snippet("pkg.utils.Base.greet")
    assert got["found"] and got["code"] == "    def greet(self):\n        return helper()" and got["start_line"] == 6
    assert not code.get_code_snippet("absent")["found"]
    assert not code.get_file_source("sample", "../../store/_commits/00000000000000000001.json")["found"]
    os.symlink("/etc/hostname", root / "link.py")
    assert not code.get_file_source("sample", "link.py")["found"]
    put(root, {"bin.py": b"a\x00b", "readme.txt": "plain\n", "ReadMe.md": "# hi\n"})
    assert "binary" in code.get_file_source("sample", "bin.py")["error"]
    readme = code.get_repo_readme("sample")
    assert readme["file_path"] == "ReadMe.md" and readme["content"] == "# hi\n"
    put(root, {"pkg/utils.py": "import os\n"})
    context = code.get_node_context("pkg.utils.helper", "sample")
    assert context["source"]["content"] == "import os\n" and context["node"]["kind"] == "Function"
    assert [r["qualified_name"] for r in context["callers"]] == [r["qualified_name"] for r in code.get_callers("pkg.utils.helper", "sample")]
    assert [r["qualified_name"] for r in context["siblings"]] == ["pkg.utils.Base", "pkg.utils.Base.greet"]
    os.remove(root / "pkg" / "core.py")
    assert "has no file" in code.get_code_snippet("pkg.core.build")["error"]


def test_node_context_keeps_query_order(spark):
    """Callers by name, not by kind; callees resolved first."""
    nodes = spark.createDataFrame([("r", "Method", "z", "a.z", "a.py", 1, 2, None), ("r", "Function", "y", "b.y", "b.py", 1, 2, None), ("r", "Function", "t", "c.t", "c.py", 1, 2, None)], S.NODES)
    edges = spark.createDataFrame([("r", "CALLS", "b.y", "c.t", "t", "b.py", 1), ("r", "CALLS", "a.z", "c.t", "t", "a.py", 1), ("r", "CALLS", "c.t", "aaa", "aaa", "c.py", 0), ("r", "CALLS", "c.t", "b.y", "y", "c.py", 1)], S.EDGES)
    row = G.node_context(nodes, edges, spark.createDataFrame([], S.IMPORTS), "r", "c.t").first()
    assert [x.qualified_name for x in row.callers] == ["a.z", "b.y"] and [x.callee for x in row.callees] == ["b.y", "aaa"]


def graph_tables(spark):
    nodes = spark.createDataFrame([("r", "File", "a", "a", "a.py", 1, 2, None), ("q", "File", "b", "b", "b.py", 1, 2, None)], S.NODES)
    return {"repos": spark.createDataFrame([("r", "r", "t", 1, 0, 1), ("q", "q", "t", 1, 0, 1)], S.REPOS), "nodes": nodes, "edges": spark.createDataFrame([], S.EDGES), "files": spark.createDataFrame([("r", "a.py", "h"), ("q", "b.py", "h")], S.FILES), "imports": spark.createDataFrame([], S.IMPORTS)}


def test_store(spark, tmp_path):
    store = provision(spark, f"file://{tmp_path}", "team_1")
    assert store.counts() == dict.fromkeys(S.TABLES, 0)
    with pytest.raises(ValueError):
        provision(spark, f"file://{tmp_path}", "No Slug")
    told = store.load(graph_tables(spark))
    assert told == store.counts() == {"repos": 2, "nodes": 2, "edges": 0, "files": 2, "imports": 0} and store.repos() == ["q", "r"]
    with pytest.raises(LoadError):
        store.load(graph_tables(spark))
    with pytest.raises(LoadError):
        store.load(graph_tables(spark) | {"nodes": spark.createDataFrame([], S.NODES)}, replace=True)
    with pytest.raises(LoadError):
        store.load(graph_tables(spark), replace=True, exclude=["absent"])
    assert store.load(graph_tables(spark), replace=True, exclude=["q"])["nodes"] == 1 and store.repos() == ["r"]
    assert store.counts(["r"])["nodes"] == 0
    store.upsert("r", "imports", spark.createDataFrame([("r", "a.py", "x", "one", "m"), ("r", "a.py", "y", "two", "m")], S.IMPORTS))
    store.upsert("r", "imports", spark.createDataFrame([("r", "a.py", "x", "new", "m"), ("r", "a.py", "x", "newer", "m")], S.IMPORTS), ["target"])
    assert sorted((r.local_name, r.target) for r in store.read("imports").collect()) == [("x", "newer"), ("y", "two")]
    store.append("r", "files", spark.createDataFrame([("r", "b.py", "g")], S.FILES))
    store.delete_files("r", spark.createDataFrame([("r", "a.py")], "repo string, path string"))
    assert {t: store.read(t).count() for t in S.TABLES} == {"repos": 1, "nodes": 0, "edges": 0, "files": 1, "imports": 0}
    assert store.commit("r", {}, batch=4) and not store.commit("r", {}, batch=4)
    assert store.vacuum() == 0 and store.vacuum(0) > 0 and store.read("files").count() == 1
    store.delete_repo("r")
    assert store.counts()["files"] == 0


def test_failed_load_leaves_the_old_graph(spark, tmp_path, monkeypatch):
    store = GraphStore(spark, f"file://{tmp_path}/s")
    store.load(graph_tables(spark))
    monkeypatch.setattr(store.log, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("stop")))
    with pytest.raises(RuntimeError):
        store.load(graph_tables(spark), replace=True, exclude=["q"])
    assert GraphStore(spark, f"file://{tmp_path}/s").repos() == ["q", "r"]


def test_ids_and_last_wins(spark):
    rows = spark.range(100).selectExpr("cast(id % 10 as string) as k", "id as v")
    got = with_ids(rows, 7, ["v"]).collect()
    assert sorted(r.id for r in got) == list(range(8, 108)) and all(r.id == r.v + 8 for r in got)
    assert next_id(with_ids(rows, 7, ["v"])) == 107 and next_id(rows.selectExpr("v as id").limit(0)) == 1
    assert sorted((r.k, r.v) for r in last_wins(rows, ["k"], ["v"]).collect()) == [(str(i), 90 + i) for i in range(10)]
    sample = G.systematic_sample(rows, ["v"], 10).collect()
    assert sorted(r.v for r in sample) == list(range(0, 100, 10))


def test_database_source(spark, tmp_path):
    path = f"{tmp_path}/graph.db"
    con = sqlite3.connect(path)
    for table, columns in S.TABLES.items():
        con.execute(f"CREATE TABLE {table}({', '.join(c.replace(' string', ' TEXT').replace(' int', ' INTEGER') for c in columns.split(', '))})")
    con.execute("INSERT INTO repos VALUES('r', 'p', 't', 250, 0, 1)")
    con.executemany("INSERT INTO nodes VALUES('r', 'Function', ?, ?, 'a.py', ?, ?, NULL)", [(f"f{i}", f"a.f{i}", i, i) for i in range(250)])
    con.commit()
    con.close()
    tables = database.read_database(spark, path, rows=100)
    assert tables["nodes"].rdd.getNumPartitions() == 3 and tables["nodes"].count() == 250 and tables["edges"].count() == 0
    code = CodeGraph(spark, GraphStore(spark, f"file://{tmp_path}/s"), str(tmp_path))
    assert code.import_database(path) == {"repos": 1, "nodes": 250, "edges": 0, "files": 0, "imports": 0}
    assert "there is a graph" in code.import_database(path)["error"] and "no database" in code.import_database(f"{tmp_path}/x.db")["error"]
    assert [r["name"] for r in code.search_symbol("f24?")] == [f"f24{i}" for i in range(10)]
    con = sqlite3.connect(path)
    con.execute("DROP TABLE imports")
    con.close()
    assert "imports" in code.import_database(path, True)["error"]


def graph_file(path, repos=("p", "q"), n=40):
    con = sqlite3.connect(path)
    for table, columns in S.TABLES.items():
        con.execute(f"CREATE TABLE {table}({', '.join(c.replace(' string', ' TEXT').replace(' int', ' INTEGER') for c in columns.split(', '))})")
    for r in repos:
        con.execute("INSERT INTO repos VALUES(?, 'p', 't', ?, 0, 1)", (r, n))
        con.executemany("INSERT INTO nodes VALUES(?, ?, ?, ?, 'a.py', ?, ?, NULL)", [(r, "Class" if i % 4 == 0 else "Function", f"f{i}", f"a.f{i}", i, i) for i in range(n)])
    con.commit()
    con.close()


def test_database_filters_are_pushed(spark, tmp_path):
    path = f"{tmp_path}/graph.db"
    graph_file(path)
    nodes = database.read_database(spark, path, columns={"nodes": ["repo", "kind", "name", "start_line"]})["nodes"]
    assert nodes.columns == ["repo", "kind", "name", "start_line"]
    some = nodes.filter("repo = 'p' and kind in ('Class', 'Method') and start_line >= 8 and name <> 'f12'")
    plan = spark._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    pushed = plan[plan.index("PushedFilters") :].split("ReadSchema")[0]
    assert all(x in pushed for x in ("repo", "kind", "start_line")), plan
    assert sorted(r.name for r in some.collect()) == sorted(f"f{i}" for i in range(8, 40, 4) if i != 12)
    reader = database._Reader(path, "nodes", ["name"], 1000)
    left = list(reader.pushFilters([database.EqualTo(("repo",), "q"), database.Not(database.In(("kind",), ("Class",))), database.EqualTo(("a", "b"), 1)]))
    assert len(left) == 1 and len(list(reader.read(reader.partitions()[0]))) == 30
    with pytest.raises(Exception, match="no such columns"):
        spark.read.format("graphfile").option("path", path).option("table", "nodes").option("columns", "other").load()


def test_import_with_connections(spark, tmp_path):
    path = f"{tmp_path}/graph.db"
    graph_file(path)
    log = log_at(spark, f"file://{tmp_path}/log")
    code = CodeGraph(spark, GraphStore(spark, f"file://{tmp_path}/s"), str(tmp_path))
    assert "error" in code.import_database(path, connections=[("p", "org/p", None)])
    assert "error" in code.import_database(path, exclude=("q",), connections=[("q", "org/q", None)], log=log, tenant_id=1)
    assert "error" in code.import_database(path, True, connections=[("p", "org/..", None)], log=log, tenant_id=1)
    assert code.import_database(path, True, connections=[("p", "org/p", "s1"), ("q", "org/q", None)], log=log, tenant_id=1)["nodes"] == 80
    assert code.import_database(path, True, connections=[("p", "org/moved", "s2")], log=log, tenant_id=1)["nodes"] == 80
    got = {(r.tenant_id, r.repo_name): (r.external_repo, r.git_ref, r.index_daily, r.github_token_id) for r in log.table("connections").collect()}
    assert got[1, "p"] == ("org/moved", "s2", True, None) and got[1, "q"] == ("org/q", None, True, None) and got[1, "a"] == ("org/a", "s0", True, 7) and len(got) == 6


def test_extractor_as_a_table_function(spark):
    """One statement from files to nodes, edges or imports."""
    register_functions(spark)
    files_in = spark.createDataFrame([("r", "pkg/utils.py", SAMPLE["pkg/utils.py"]), ("r", "pkg/core.py", SAMPLE["pkg/core.py"]), ("r", "bad.py", "def ("), ("r", "a.css", "b {}"), ("r", "none", None)], "repo string, path string, text string")
    files_in.createOrReplaceTempView("source_files")
    made = spark.sql("SELECT f.repo, n.kind, n.qualified_name, n.end_line FROM source_files f, LATERAL extracted('nodes', f.path, f.text) n").collect()
    graph = X.extract(files_in.filter("path like '%.py' or path like '%.css'").select("repo", "path", F.length("text").cast("long").alias("size"), F.col("text").cast("binary").alias("content")))
    assert sorted(map(tuple, made)) == sorted((r.repo, r.kind, r.qualified_name, r.end_line) for r in graph.nodes.collect()) and len(made) > 6
    edges = spark.sql("SELECT e.edge_type, e.src_qname, e.dst_raw FROM source_files f, LATERAL extracted('edges', f.path, f.text) e").collect()
    assert sorted(map(tuple, edges)) == sorted((r.edge_type, r.src_qname, r.dst_raw) for r in graph.edges.collect())
    imports = spark.sql("SELECT i.local_name, i.target FROM source_files f, LATERAL extracted('imports', f.path, f.text) i").collect()
    assert sorted(map(tuple, imports)) == sorted((r.local_name, r.target) for r in graph.imports.collect())
    with pytest.raises(Exception, match="nodes, edges or imports"):
        spark.sql("SELECT * FROM extracted('other', 'a.py', 'x')").collect()


def test_payload(code, tmp_path):
    code.index_repository("sample", "sample")
    parts = code.graph_payload(2)
    out = payload.parse(payload.payload_json(**parts).first()["payload"])
    assert len(out["nodes"]) == 2 and out["stats"]["nodes"] == 2
    ids = {n["id"] for n in out["nodes"]}
    assert all(x["source"] in ids and x["target"] in ids for x in out["links"])
    payload.write_payload(**code.graph_payload(), folder=f"{tmp_path}/out")
    assert {json.loads(x)["name"] for f in os.listdir(f"{tmp_path}/out/repos") if f.endswith(".json") for x in open(f"{tmp_path}/out/repos/{f}")} == {"sample"}
    assert payload.result([1]) == {"result": [1]} and payload.result({"a": 1}) == {"a": 1}


def words_of(path, qname, text):
    found = X.Found()
    if "boom" in text:
        raise RuntimeError("boom")
    for i, line in enumerate(text.splitlines(), 1):
        found.node("Function", line, f"{qname}.{line}", i, i)
    return found


def test_registered_extractor(spark, tmp_path):
    put(tmp_path / "r", {"a.wrd": "one\ntwo", "b.wrd": "boom", "c.py": "x = 1\n"})
    X.register_extractor("words", ["wrd"], words_of)
    try:
        with pytest.raises(ValueError):
            X.register_extractor("other", ["py"], words_of)
        graph = X.extract(files.scan_trees(spark, {"r": str(tmp_path / "r")}))
        assert {r.qualified_name for r in graph.nodes.filter("kind = 'Function'").collect()} == {"a.wrd.one", "a.wrd.two"}
        assert {(r.path, r.status) for r in graph.status.collect()} == {("a.wrd", "indexed"), ("b.wrd", "failed"), ("c.py", "indexed")}
    finally:
        X.EXTRACTORS.pop("words")
        files.FORMATS.pop("words")


def test_confinement(tmp_path):
    assert files.confined(str(tmp_path), "a/b") == f"{os.path.realpath(tmp_path)}/a/b"
    assert files.confined("hdfs://host/work", "a") == "hdfs://host/work/a"
    for root in (str(tmp_path), "hdfs://host/work"):
        with pytest.raises(ValueError):
            files.confined(root, "..", "x")


def test_tarball_keeps_confined(spark, tmp_path):
    put(tmp_path / "t", {"top/a.py": "x = 1\n"})
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        tar.add(tmp_path / "t" / "top", "top")
    assert [r.path for r in files.scan_tarballs(spark, {"r": str(tmp_path / "a.tar.gz")}).select(F.col("path")).collect()] == ["a.py"]


def test_appends_are_parts_of_their_own(spark, tmp_path):
    """An append writes its rows only, a point read opens the parts that may hold the file, compaction joins them."""
    store = GraphStore(spark, f"file://{tmp_path}/s")
    files = lambda *paths: spark.createDataFrame([("r", p, "h") for p in paths], S.FILES)
    store.append("r", "files", files("a.py", "c.py"))
    store.append("r", "files", files("d.py", "f.py"))
    store.append("r", "files", files("b.py"))
    parts = store.parts("files", "r")
    assert [(p["rows"], p["low"], p["high"]) for p in parts] == [(2, "a.py", "c.py"), (2, "d.py", "f.py"), (1, "b.py", "b.py")]
    assert [p["rows"] for p in store.parts("files", "r", file="d.py")] == [2] and [r.path for r in store.read("files", "r", "d.py").collect()] == ["d.py"]
    assert store.read("files", "r", "x.py").count() == 0 and store.counts()["files"] == 5
    assert store.compact("r", "files") and not store.compact("r", "files") and len(store.parts("files")) == 1 and store.read("files").count() == 5
    assert store.vacuum(0) == 3


def test_commit_log(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log")
    assert log.state() == (0, {})
    for n in range(40):
        assert log.commit(n, {f"k{n % 7}": n, "gone": None if n % 2 else n})
    assert not log.commit(20, {"k0": -1})
    assert log.state() == (40, {f"k{n % 7}": n for n in range(33, 40)})
    assert log.changed_since(38) == (40, {"k3", "k4", "gone"}) and [f for f in os.listdir(tmp_path / "log" / "_commits") if ".full." in f]


def test_two_writers_lose_nothing(spark, tmp_path):
    """Writers at once: appends to one table, upserts of one key space, and commits to repositories of their own."""
    root = f"file://{tmp_path}/s"
    GraphStore(spark, root).commit("own", {"files": spark.createDataFrame([], S.FILES)})

    def work(k):
        store = GraphStore(spark, root)
        for n in range(4):
            store.append("own", "files", spark.createDataFrame([("own", f"{k}-{n}", "h")], S.FILES))
            store.upsert("own", "imports", spark.createDataFrame([("own", "a.py", f"{k}-{n}", "t", "m")], S.IMPORTS))
            store.commit(f"r{k}", {"files": spark.createDataFrame([(f"r{k}", f"{n}", "h")], S.FILES)})

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(work, range(3)))
    store = GraphStore(spark, root)
    want = {f"{k}-{n}" for k in range(3) for n in range(4)}
    assert {r.path for r in store.read("files", "own").collect()} == want and {r.local_name for r in store.read("imports", "own").collect()} == want
    assert sorted((r.repo, r.path) for r in store.read("files").filter("repo <> 'own'").collect()) == [(f"r{k}", "3") for k in range(3)]


def test_stale_commits_are_refused(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([("r", "a", "h")], S.FILES)
    store.commit("r", {"files": rows})
    seen = store.version()
    store.append("q", "files", rows)
    assert store.commit("r", {"files": rows}, since=seen)
    with pytest.raises(ConflictError):
        store.commit("r", {"files": rows}, since=seen)
