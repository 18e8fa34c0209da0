"""File trees and archives as rows (repo, path, size, content), and columns derived from them.

Spark's own file sources pass over names that begin with ``_`` or ``.`` (package initialisers, ``.env``), so
trees are listed and read in tasks through pyarrow's file systems: one listing task per repository or
archive, reading dealt out by file.
"""

from __future__ import annotations

import os
import posixpath
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grafloom.functions import scalars as X
from grafloom.schema import BINARY_PROBE, MAX_FILE_BYTES, PREVIEW_BYTES

# Folders that are passed over, and the format of a file by name and by extension.
PRUNED = ["__pycache__", "node_modules", "venv", "env", "dist", "build", ".eggs", "site-packages", ".hg", ".svn", "coverage", "bower_components", "vendor", "target"]
GENERIC_NAMES = ["Dockerfile", "Makefile", "makefile", "Procfile", ".gitignore", ".dockerignore", ".editorconfig", ".npmrc", ".prettierrc", ".eslintrc", ".babelrc", ".env"]
FORMATS = {
    "python": ["py"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "typescript": ["ts", "tsx"],
    "html": ["html", "htm", "jinja", "jinja2", "j2"],
    "css": ["css"],
    "json": ["json"],
    "yaml": ["yaml", "yml"],
    "generic": ["toml", "xml", "ini", "cfg", "conf", "properties", "lock"],
}
README_RANK = ["md", "markdown", "rst", "txt", ""]

_FILES = "repo string, path string, size long, content binary"
_ARROW = pa.schema([("repo", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("content", pa.binary())])
_BATCH_BYTES = 16 << 20


def format_of(path: Column) -> Column:
    """Format by exact name, the ``.env`` family, or extension in any case; null where none is known."""
    name, ext = F.element_at(F.split(path, "/"), -1), X.extension(F.regexp_replace(path, r"(^|/)\.+", "$1"))
    found = F.when(name.isin(GENERIC_NAMES) | name.startswith(".env."), "generic")
    for kind, extensions in FORMATS.items():
        found = found.when(ext.isin(extensions), kind)
    return found


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3] or b"")
        if size >= _BATCH_BYTES or len(held) >= 10_000:
            yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in held], _ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in held], _ARROW)


def _walk(root: str) -> Iterator[tuple[str, int]]:
    store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    base = base.rstrip("/")
    todo = [base]
    while todo:
        for entry in store.get_file_info(fs.FileSelector(todo.pop())):
            if entry.type == fs.FileType.Directory:
                linked = isinstance(store, fs.LocalFileSystem) and os.path.islink(entry.path)
                if not (linked or entry.base_name.startswith(".") or entry.base_name in PRUNED):
                    todo.append(entry.path)
            elif entry.type == fs.FileType.File:
                yield entry.path[len(base) + 1 :], entry.size


def _sources(spark: SparkSession, places: dict[str, str]) -> DataFrame:
    rows = spark.createDataFrame(sorted(places.items()), "repo string, root string")
    return rows.repartition(max(1, len(places)), "repo", "root")


_LISTED = "repo string, root string, path string, size long"


def list_trees(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """(repo, root, path, size) of the files with a known format below each root (a path or URI that all executors
    reach). Linked, hidden and noise folders aren't entered."""

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for repo, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = [{"repo": repo, "root": root, "path": p, "size": n} for p, n in _walk(root)]
                yield pa.RecordBatch.from_pylist(found, pa.schema([("repo", pa.string()), ("root", pa.string()), ("path", pa.string()), ("size", pa.int64())]))

    return _sources(spark, roots).mapInArrow(listing, _LISTED).filter(format_of(F.col("path")).isNotNull())


def read_files(listed: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(repo, path, size, content) of listed files; content is null where a file is larger than ``max_bytes`` or
    can't be read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for repo, root, path, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
                    data = None
                    if size <= max_bytes:
                        try:
                            with store.open_input_stream(f"{base.rstrip('/')}/{path}") as stream:
                                data = stream.read()
                        except OSError:
                            pass  # counted as skipped: content stays null
                    yield repo, path, size, data

        yield from _batches(rows())

    dealt = listed.select("repo", "root", "path", "size").repartition(listed.sparkSession.sparkContext.defaultParallelism, "repo", "path")
    return dealt.mapInArrow(read, _FILES)


def scan_trees(spark: SparkSession, roots: dict[str, str], max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(repo, path, size, content): ``list_trees`` and ``read_files`` in one."""
    return read_files(list_trees(spark, roots), max_bytes)


def confined(root: str, *parts: str) -> str:
    """``root`` joined with ``parts``; an error if the result, links followed, lies outside ``root``. A URI's path is
    normalised instead, as its store has no links."""
    if "://" in root:
        scheme, rest = root.split("://", 1)
        base = posixpath.normpath(f"/{rest}")
        full = posixpath.normpath(posixpath.join(base, *parts))
        place = f"{scheme}://{full[1:]}"
    else:
        base = os.path.realpath(root)
        full = place = os.path.realpath(os.path.join(base, *parts))
    if full != base and not full.startswith(base.rstrip("/") + "/"):
        raise ValueError(f"outside of the workspaces: {posixpath.join(*parts)!r}")
    return place


def scan_tarballs(spark: SparkSession, archives: dict[str, str], max_bytes: int = MAX_FILE_BYTES, max_total: int = 2_000_000_000) -> DataFrame:
    """The same rows from tar archives, streamed; the top folder is taken off. Only regular files count, names
    that are absolute or leave the archive are passed over, and more than ``max_total`` bytes are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for repo, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    store, path = fs.FileSystem.from_uri(place) if "://" in place else (fs.LocalFileSystem(), place)
                    total = 0
                    with store.open_input_stream(path, compression=None) as stream, tarfile.open(fileobj=stream, mode="r|*") as tar:
                        for member in tar:
                            parts = member.name.split("/")
                            if not member.isreg() or member.name.startswith("/") or ".." in parts or len(parts) < 2:
                                continue
                            folders = parts[1:-1]
                            if any(f.startswith(".") or f in PRUNED for f in folders):
                                continue
                            total += member.size
                            if total > max_total:
                                raise ValueError(f"{place} holds more than {max_total} bytes")
                            yield repo, "/".join(parts[1:]), member.size, tar.extractfile(member).read() if member.size <= max_bytes else None

        yield from _batches(rows())

    return _sources(spark, archives).mapInArrow(run, _FILES).filter(format_of(F.col("path")).isNotNull())


def text_of(content: Column) -> Column:
    """UTF-8 text; malformed bytes become replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def file_table(files: DataFrame) -> DataFrame:
    """(repo, path, hash) of the files that were read."""
    return files.filter(F.col("content").isNotNull()).select("repo", "path", F.sha2("content", 256).alias("hash"))


def preview(files: DataFrame, max_bytes: int = PREVIEW_BYTES) -> DataFrame:
    """(repo, path, found, error, text, bytes, truncated, line_count): a cut text ends at its last line feed;
    a zero byte near the beginning means binary, which isn't shown."""
    head = F.substring(F.col("content"), 1, max_bytes)
    zero = F.instr(F.hex(F.substring(head, 1, BINARY_PROBE)), "00")  # an odd place is a whole byte
    binary = F.regexp_replace(F.hex(F.substring(head, 1, BINARY_PROBE)), "(..)", "$1 ").contains("00 ") & (zero > 0)
    cut = F.length("content") > max_bytes
    whole = text_of(head)
    shown = F.when(cut & (F.instr(whole, "\n") > 1), F.regexp_replace(whole, r"\n[^\n]*\z", "")).otherwise(whole)
    rows = files.select("repo", "path", F.length("content").cast("long").alias("bytes"), cut.alias("truncated"), F.when(F.col("content").isNull(), "unreadable").when(binary, "binary").alias("error"), shown.alias("_t"))
    text = F.when(F.col("error").isNull(), F.col("_t"))
    return rows.select("repo", "path", F.col("error").isNull().alias("found"), "error", text.alias("text"), "bytes", "truncated", X.line_count(text).alias("line_count"))


def readme_of(paths: DataFrame) -> DataFrame:
    """(repo, path): of each repository's root files named readme in any case, the best by extension, then name."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    rank = F.array_position(F.lit([f".{e}" if e else "" for e in README_RANK]), ext)
    roots = paths.filter(F.col("path").rlike(r"(?i)^readme(\.[^./]*)?$"))
    return roots.groupBy("repo").agg(F.min_by("path", F.struct(F.when(rank == 0, 99).otherwise(rank), F.col("path"))).alias("path"))
