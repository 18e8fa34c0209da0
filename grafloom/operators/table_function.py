"""Extraction as a function of SQL: ``SELECT ... FROM files f, LATERAL extracted('nodes', f.path, f.text) n``.

The first argument, a literal, is ``nodes``, ``edges`` or ``imports`` and decides the columns. A file that has no format, no
text or doesn't parse gives no rows. Formats without a parser (HTML without templates, CSS, JSON and other configuration)
give their file's node; their references are column expressions of ``extract`` and not told here.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.scalars import CODE_EXTENSIONS
from ..sources.files import FORMATS, GENERIC_NAMES
from .extract import COMPOSE_FILES, EXTRACTORS, SCRIPTS, Found, _one

COLUMNS = {
    "nodes": "kind string, name string, qualified_name string, file_path string, start_line int, end_line int, signature string",
    "edges": "edge_type string, src_qname string, dst_qname string, dst_raw string, resolved int",
    "imports": "local_name string, target string, kind string",
}


def extension_of(path: str) -> str:
    """What ``scalars.extension`` gives."""
    found = re.search(r"\.([^./]+)$", path)
    return found[1].lower() if found else ""


def format_named(path: str) -> str | None:
    """What ``files.format_of`` gives."""
    name = posixpath.basename(path)
    if name in GENERIC_NAMES or name.startswith(".env."):
        return "generic"
    return next((kind for kind, known in FORMATS.items() if extension_of(name.lstrip(".")) in known), None)


def module_name(path: str) -> str:
    """What ``scalars.file_qname`` gives."""
    if extension_of(path) not in CODE_EXTENSIONS:
        return path
    parts = re.sub(r"\.[^./]+$", "", path).split("/")
    return ".".join(parts[:-1] if len(parts) > 1 and parts[-1] in ("__init__", "index") else parts)


def file_rows(path: str, text: str) -> Found | None:
    """All rows of one file, its own node first; None where there are none."""
    lang, name = format_named(path), posixpath.basename(path)
    if lang is None:
        return None
    qname = module_name(path)
    config = lang in ("json", "yaml", "generic")
    out = Found()
    label = qname.rsplit(".", 1)[-1] if extension_of(path) in CODE_EXTENSIONS else name
    out.node("Config" if config else "File", label, qname, 1, text.count("\n") + 1)
    parsed = lang in EXTRACTORS or lang in ("python", *SCRIPTS) or (lang == "html" and any(x in text for x in ("{%", "{{", "{#"))) or (lang == "yaml" and name in COMPOSE_FILES)
    if parsed:
        try:
            found = _one(lang, path, qname, text, EXTRACTORS)
        except Exception as e:
            if lang not in EXTRACTORS and not isinstance(e, (SyntaxError, ValueError, RecursionError, MemoryError)):
                raise
            return None
        for mine, theirs in ((out.nodes, found.nodes), (out.edges, found.edges), (out.imports, found.imports)):
            for k, v in theirs.items():
                mine.setdefault(k, v)
    return out


class Extracted:
    @staticmethod
    def analyze(what: AnalyzeArgument, path: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
        if what.value not in COLUMNS:
            raise ValueError("the first argument must be nodes, edges or imports, as a literal")
        kinds = {"int": IntegerType(), "string": StringType()}
        return AnalyzeResult(StructType([StructField(n, kinds[k]) for n, k in (c.split() for c in COLUMNS[what.value].split(", "))]))

    def eval(self, what: str, path: str | None, text: str | None) -> Iterator[tuple]:
        found = file_rows(path, text) if path is not None and text is not None else None
        names = [c.split()[0] for c in COLUMNS[what].split(", ")]
        for row in getattr(found, what).values() if found else ():
            yield tuple(path if n == "file_path" else row[n] for n in names)


def register_functions(spark: SparkSession) -> None:
    """Makes ``extracted`` known to the session's SQL; rows travel in Arrow batches."""
    spark.udtf.register("extracted", udtf(Extracted, useArrow=True))
