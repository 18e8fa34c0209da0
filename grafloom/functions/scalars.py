"""Scalar functions of the graph model as column expressions (and one driver-side pattern helper)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CODE_EXTENSIONS = ["py", "js", "jsx", "mjs", "cjs", "ts", "tsx"]
REPO_NAME = r"^[A-Za-z0-9._-]{1,100}$"
TENANT_SLUG = r"^[a-z0-9][a-z0-9_]{0,39}$"
#: Where Python's str.splitlines breaks.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]"


def like_pattern(glob: str) -> str:
    """A LIKE pattern (escape backslash) for a glob; text without a wildcard means a substring."""
    if not glob:
        return "%"
    quoted = "".join("\\" + c if c in "\\%_" else c for c in glob)
    if "*" in glob or "?" in glob:
        return quoted.replace("*", "%").replace("?", "_")
    return f"%{quoted}%"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def file_qname(path: Column) -> Column:
    """Dotted module name of a code file (a last ``__init__`` or ``index`` goes, unless it stands alone);
    the path itself for any other file."""
    parts = F.split(F.regexp_replace(path, r"\.[^./]+$", ""), "/")
    drop = (F.size(parts) > 1) & F.element_at(parts, -1).isin("__init__", "index")
    dotted = F.array_join(F.when(drop, F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(parts), ".")
    return F.when(extension(path).isin(*CODE_EXTENSIONS), dotted).otherwise(path)


def is_inline_data(ref: Column) -> Column:
    return F.lower(F.substring(F.trim(ref), 1, 5)) == "data:"


def is_external(ref: Column) -> Column:
    return ref.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:") | ref.startswith("//")


def clean_ref(ref: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(ref), "^'+|'+$", ""), '^"+|"+$', ""))


def resolve_path(base_file: Column, ref: Column) -> Column:
    """Path of a reference from a file, normalised segment by segment; null where it leaves the root or is empty."""
    bare = F.regexp_replace(ref, r"[?#].*$", "")
    folder = F.regexp_replace(base_file, r"[^/]*$", "")
    joined = F.when(bare.startswith("/"), bare).otherwise(F.concat(folder, bare))
    start = F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("ok"))

    def step(acc: Column, seg: Column) -> Column:
        up = seg == ".."
        rest = F.when(up & (F.size(acc["p"]) > 0), F.slice(acc["p"], F.lit(1), F.greatest(F.size(acc["p"]) - 1, F.lit(0)))).when(up | seg.isin("", "."), acc["p"]).otherwise(F.concat(acc["p"], F.array(seg)))
        return F.struct(rest.alias("p"), (acc["ok"] & ~(up & (F.size(acc["p"]) == 0))).alias("ok"))

    done = bound(F.aggregate(F.split(joined, "/"), start, step), lambda d: F.when(d["ok"] & (F.size(d["p"]) > 0), F.array_join(d["p"], "/")))
    plain = ~joined.rlike(r"(?:^|/)\.{0,2}(?:/|\z)")  # no segment is empty or made of dots
    return F.when(F.length(bare) > 0, F.when(plain, joined).otherwise(done))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def signature(text: Column, most: int = 500) -> Column:
    return F.substring(one_line(text), 1, most)


def line_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1, inclusive), joined by line feeds."""
    lines = F.split(F.regexp_replace(text, rf"(?:{LINE_BREAK})$", ""), LINE_BREAK)
    return F.array_join(F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(end - F.greatest(start, F.lit(1)) + 1, F.lit(0))), "\n")


def last_segment(name: Column) -> Column:
    return F.element_at(F.split(name, "[./]"), -1)


def safe_relative(path: Column) -> Column:
    return (F.length(path) > 0) & ~F.exists(F.split(path, "/"), lambda s: s.isin("", ".", ".."))


def valid_repo_name(name: Column) -> Column:
    return name.rlike(REPO_NAME)


def package_dependencies(text: Column) -> Column:
    """Names in the four dependency sections of a package.json, in first-seen order; empty for broken JSON."""
    sections = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
    doc = F.from_json(text, ", ".join(f"{s} map<string,string>" for s in sections))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*(F.coalesce(F.map_keys(doc[s]), none) for s in sections)))
