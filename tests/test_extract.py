import tarfile

import pytest
from pyspark.sql import functions as F

from grafloom.operators import extract as E
from grafloom.operators import resolve as R
from grafloom.sources import files as S

TREE = {
    "pkg/__init__.py": "",
    "pkg/utils.py": "import os.path\nimport numpy as np\nfrom . import core as c\nfrom __future__ import annotations\n\n\ndef helper(a: 'x', b: Base = f(1)) -> list[Base]:\n    return np.sum(a)\n\n\nclass Base(object, metaclass=M):\n    size: typing.Size = 3\n\n    @deco(1)\n    async def greet(self):\n        def inner():\n            hidden()\n        g = lambda: lost()\n        return self.other(helper(1))\n",
    "pkg/broken.py": "def (:\n",
    "pkg/core.py": "from .utils import Base, helper\n\n\nclass Widget(Base):\n    def run(self):\n        helper(1)\n",
    "index.html": '<!-- <a href="no.html"> --><link href="site.css"><script src="/static/a.js">x = "<a href=\'q.html\'>"</script><a href="#top"></a><img src="data:x"><a href=\'https://x.test/\'></a>{% extends "base.html" %}{% from "m/forms.html" import field as f, row with context %}\n{% macro own(a) %}{{ f.x(a) }}{{ url_for(1) }}{% endmacro %}',
    "site.css": '/* @import "no.css"; */ @import "base.css"; @import url(theme.css);',
    "package.json": '{"dependencies": {"react": "1"}, "devDependencies": {"vite": "2"}}',
    "docker-compose.yml": "version: '3'\nservices:\n  web:\n    image: x\n    depends_on:\n      - db\n      - cache\n  db:\n    image: y\n  cache:\n    depends_on:\n      db:\n        condition: ok\nvolumes:\n  data:\n",
    "config.ini": "a=1\n",
    ".env.local": "A=1\n",
    "static/a.js": "let x\n",
    "js/base.ts": "export class Base { run() { return 1 } }\n",
    "js/app.ts": "import { Base } from './base'\nexport class App extends Base { go() { this.stop() }\n stop() {} }\n",
    "js/bad.js": "function (\n",
    "node_modules/x/a.py": "x()\n",
    "notes.unknown": "x",
    "big.py": "x = 1\n" * 100,
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


@pytest.fixture(scope="module")
def graph(spark, tree):
    return E.extract(S.scan_trees(spark, {"r": str(tree)}, max_bytes=590))


def test_status_and_files(graph):
    got = {r.path: r.status for r in graph.status.collect()}
    assert got.pop("big.py") == "skipped" and got.pop("pkg/broken.py") == got.pop("js/bad.js") == "failed"
    assert set(got) == set(TREE) - {"big.py", "pkg/broken.py", "js/bad.js", "node_modules/x/a.py", "notes.unknown"} and set(got.values()) == {"indexed"}
    assert {r.path for r in graph.files.collect()} == set(got)


def test_python(graph):
    nodes = {r.qualified_name: r for r in graph.nodes.collect()}
    assert nodes["pkg.utils.helper"].signature == "def helper(a: 'x', b: Base = f(1)) -> list[Base]"
    assert nodes["pkg.utils.Base"].signature == "class Base(object, metaclass=M)" and nodes["pkg"].kind == "File"
    assert (nodes["pkg.utils.Base.greet"].kind, nodes["pkg.utils.Base.greet"].start_line, nodes["pkg.utils.Base.greet.inner"].kind) == ("Method", 15, "Function")
    edges = {(r.edge_type, r.src_qname, r.dst_raw) for r in graph.edges.filter("src_file = 'pkg/utils.py' AND edge_type <> 'CONTAINS'").collect()}
    greet = "pkg.utils.Base.greet"
    assert edges == {("IMPORTS", "pkg.utils", "os"), ("IMPORTS", "pkg.utils", "np"), ("IMPORTS", "pkg.utils", "c"), ("USES_TYPE", "pkg.utils.helper", "Base"), ("CALLS", "pkg.utils.helper", "np.sum"), ("INHERITS", "pkg.utils.Base", "object"), ("USES_TYPE", "pkg.utils.Base", "typing.Size"), ("CALLS", f"{greet}.inner", "hidden"), ("CALLS", greet, "self.other"), ("CALLS", greet, "helper")}
    imports = {(r.local_name, r.target, r.kind) for r in graph.imports.filter("file_path = 'pkg/utils.py'").collect()}
    assert imports == {("os", "os", "module"), ("np", "numpy", "module"), ("c", "pkg.core", "symbol")}


def test_web_and_config(graph):
    refs = {(r.file_path, r.local_name, r.target, r.kind) for r in graph.imports.filter("file_path NOT LIKE 'pkg/%' AND file_path NOT LIKE 'js/%'").collect()}
    compose = {("docker-compose.yml", f"{a}->{b}", f"docker-compose.yml::{b}", "service") for a, b in (("web", "db"), ("web", "cache"), ("cache", "db"))}
    assert refs == compose | {("index.html", "site.css", "site.css", "asset"), ("index.html", "/static/a.js", "static.a", "asset"), ("index.html", "https://x.test/", "https://x.test/", "external"), ("index.html", "base.html", "base.html", "template"), ("index.html", "m/forms.html", "m/forms.html", "template"), ("site.css", "base.css", "base.css", "asset"), ("site.css", "theme.css", "theme.css", "asset"), ("package.json", "react", "react", "external"), ("package.json", "vite", "vite", "external")}
    assert [(r.src_qname, r.dst_raw) for r in graph.edges.filter("src_file = 'index.html' AND edge_type = 'CALLS'").collect()] == [("index.html", "f.x")]
    spans = {r.name: (r.start_line, r.end_line) for r in graph.nodes.filter("kind = 'Service'").collect()}
    assert spans == {"web": (3, 7), "db": (8, 9), "cache": (10, 13)}
    assert {r.name for r in graph.nodes.filter("kind = 'Config'").collect()} == {"package.json", "docker-compose.yml", "config.ini", ".env.local"}


def test_resolved(graph):
    done = {(r.src_qname, r.dst_raw): r.dst_qname for r in R.resolve_edges(graph.edges, graph.nodes, graph.imports).filter("resolved = 1 AND src_file = 'pkg/core.py' AND edge_type IN ('CALLS', 'INHERITS')").collect()}
    assert done == {("pkg.core.Widget.run", "helper"): "pkg.utils.helper", ("pkg.core.Widget", "Base"): "pkg.utils.Base"}


def test_script_resolved(graph):
    done = {(r.edge_type, r.src_qname, r.dst_qname) for r in R.resolve_edges(graph.edges, graph.nodes, graph.imports).filter("resolved = 1 AND src_file = 'js/app.ts' AND edge_type <> 'CONTAINS'").collect()}
    assert {("INHERITS", "js.app.App", "js.base.Base"), ("CALLS", "js.app.App.go", "js.app.App.stop")} <= done


def test_tarball(spark, tree, tmp_path):
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as tar:
        tar.add(tree, "top")
    a, b = S.scan_trees(spark, {"r": str(tree)}), S.scan_tarballs(spark, {"r": str(tmp_path / "t.tar.gz")})
    assert sorted(a.collect()) == sorted(b.collect())


def test_preview_and_readme(spark):
    rows = [("r", "README.txt", 5, bytearray(b"ab\ncd")), ("r", "readme.md", 3, bytearray(b"a\x00b")), ("r", "x/readme", 1, bytearray(b"z")), ("s", "x", 9, None)]
    files = spark.createDataFrame(rows, S._FILES)
    got = {r.path: (r.found, r.error, r.text, r.truncated, r.line_count) for r in S.preview(files, 4).collect()}
    assert got["README.txt"] == (True, None, "ab", True, 1) and got["readme.md"][:3] == (False, "binary", None) and got["x"][:2] == (False, "unreadable")
    assert [tuple(r) for r in S.readme_of(files).collect()] == [("r", "readme.md")]


def test_compose_flow_style():
    """Flow mappings of services and dependencies, over one line or several, give what block style gives."""
    from grafloom.operators.extract import _flow, compose

    block = compose("c.yml", "services:\n  web:\n    image: x\n    depends_on:\n      db:\n        condition: ok\n      cache: {}\n  db:\n    image: y\n")
    flow = compose("c.yml", "services: {web: {image: 'x:1', depends_on: {db: {condition: ok}, cache: {}}},\n  db: {image: y}}\n")
    mixed = compose("c.yml", "services:\n  web: {image: x, depends_on: [db,\n    cache]}\n  db:\n    image: y\n")
    for found in (flow, mixed):
        assert set(found.edges) == set(block.edges) and set(found.imports) == set(block.imports)
        assert [n["name"] for n in found.nodes.values()] == ["web", "db"]
    assert _flow("{a: [x, 'y, z'], b: http://h:1/p, c: {d: }}") == {"a": ["x", "y, z"], "b": "http://h:1/p", "c": {"d": ""}}


def test_template_grammar():
    """Quotes, comments, aliases, context clauses and attribute calls of templates."""
    from grafloom.operators.extract import template

    source = """{# {% import "no.html" as no %} #}{%- extends 'base.html' -%}
{% from "forms.html" import field, button as btn without context %}{% import 'm.html' as m %}
{% macro own(a, b=1) %}{{ caller() }}{% endmacro %}{% call m.box(field("x()")) %}{{ btn ( 1 ) }}{{ a.field() }}{{ url_for('x') }}{% endcall %}
{% include "part.html" ignore missing %}{% include name %}"""
    found = template("t.html", source)
    assert list(found.refs) == ["base.html", "forms.html", "m.html", "part.html"]
    assert {e["dst_raw"] for e in found.edges.values() if e["edge_type"] == "CALLS"} == {"m.box", "field", "btn"}
    assert [(n["name"], n["start_line"]) for n in found.nodes.values()] == [("own", 3)]


def test_files_are_parsed_once_and_by_all_cores(spark, monkeypatch):
    """Few bytes of keys are dealt to more than one task, and a query that needs one table makes no other."""
    from grafloom import catalog_files as C
    from grafloom.operators import extract as X

    folder, labels = "/root/testdata/sf0.001", []
    assert C._files(spark, folder).filter("path LIKE 'src/%'").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    monkeypatch.setattr(X, "staged", lambda df, label, real=X.staged: (labels.append(label), real(df, label))[1])
    monkeypatch.setattr(C, "table", None)
    monkeypatch.setattr("grafloom.sources.adapters._MADE", {})
    assert C.extract_status(spark, folder).count() and C.extract_imports(spark, folder).count() and C.extract_nodes(spark, folder).count()
    assert labels == ["extract"]


@pytest.mark.parametrize("header, told", [("def f(a, b):", "(a, b)"), ("def f (a,  b) :", "(a, b)"), ("class A:", ""), ("class A(B, C): pass", "(B, C)"), ("def f(a=(1, 2)) -> x:", "(a=(1, 2))"), ("def f[T](a):", "(a)"), ("def f(\n  a,\n  b\n):", "( a, b )")])
def test_headers(header, told):
    from grafloom.operators.extract import _bracketed

    assert _bracketed(header) == told


@pytest.mark.parametrize("ref, place", [("a.js", "x/a.js"), ("../a.js?v=1", "a.js"), ("./b//c.js", "x/b/c.js"), ("/r/s.js", "r/s.js"), ("../../a.js", None), ("#top", None), ("a/..", "x"), ("..a/.b", "x/..a/.b"), ("d/", "x/d")])
def test_places(spark, ref, place):
    from grafloom.functions.scalars import resolve_path

    assert spark.range(1).select(resolve_path(F.lit("x/y.html"), F.lit(ref))).first()[0] == place
