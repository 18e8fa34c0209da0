"""Token-id files: frequency-ranked ids, byte-aligned variable-length codes, control bytes kept apart.

A folder holds ``ranks-<name>.bin`` (token ids, most frequent first) and shards in ascending document order. A
shard is: magic ``GTF1``; document count and id count (two little-endian uint64); a byte per document that
tells whether its id is null; document ids (int64); ids per document (uint64); the control bytes, one for
four ids, two bits each giving a code's length less one; the codes' bytes. Decoding looks control bytes up
in a table of 256 x 4 lengths and gathers the bytes with numpy.

A task writes each shard under a name of its own and reports it in the manifest; only shards in the
manifest are read, so a task that ran twice leaves a file that nobody reads. Ranks have a name of their own in each
write, which the manifest tells, so a folder may be written to again: what was written before stays readable. The folder
must be one that pyarrow's file systems reach (local or mounted, HDFS, S3, GCS).

Defined cases: null text is the empty text (only the end id); null ids sort first; rows that repeat an id
are ordered by a hash of their tokens; extra columns are ignored; an empty table writes no shard.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import add_sketches, bounded_batches, lean, new_folder, sketch_rows, staged, unstage
from .tokens import encoder

SHARD_IDS = 2_000_000
SHARDS_A_TASK = 4
VOCAB_CELLS = 1 << 16
_MAGIC = b"GTF1"
_CODE = np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3
_LENGTHS = (_CODE + 1).astype(np.uint8)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and code bytes of unsigned 32-bit numbers."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    control = (codes.reshape(-1, 4) << np.arange(0, 8, 2, dtype=np.uint8)).sum(1).astype(np.uint8)
    body = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), body.tobytes()


def unpack_ranks(control: np.ndarray, body: np.ndarray, n: int) -> np.ndarray:
    size = _LENGTHS[control].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(size) - size
    out = body[at].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= body[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_shard(path: str, doc_ids: list[int | None], lengths: np.ndarray, ranks: np.ndarray) -> None:
    control, body = pack_ranks(ranks)
    system, name = fs.FileSystem.from_uri(path)
    with system.open_output_stream(name) as f:
        f.write(_MAGIC + struct.pack("<QQ", len(doc_ids), len(ranks)))
        f.write(bytes(x is None for x in doc_ids))
        f.write(np.array([x or 0 for x in doc_ids], "<i8").tobytes())
        f.write(np.asarray(lengths, "<u8").tobytes())
        f.write(control)
        f.write(body)


def read_shard(path: str) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, ids per document, ranks)."""
    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_stream(name) as f:
        raw = f.read()
    if raw[:4] != _MAGIC:
        raise ValueError(f"{path} is not a token file")
    docs, ids = struct.unpack_from("<QQ", raw, 4)
    at = 20
    void = np.frombuffer(raw, bool, docs, at)
    names = np.frombuffer(raw, "<i8", docs, at + docs)
    lengths = np.frombuffer(raw, "<u8", docs, at + 9 * docs).astype(np.int64)
    at += 17 * docs
    control = np.frombuffer(raw, np.uint8, -(-ids // 4), at)
    body = np.frombuffer(raw, np.uint8, -1, at + len(control))
    return [None if v else x for v, x in zip(void.tolist(), names.tolist(), strict=True)], lengths, unpack_ranks(control, body, ids)


@lru_cache(maxsize=2)
def read_ranks(path: str) -> np.ndarray:
    """The ids of a file that is written once under its name, so workers may keep it."""
    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_stream(name) as f:
        return np.frombuffer(f.read(), "<u4")


def _tokenize(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in tk.byte_slices(batch.column(1)):
                ids, at = encoder(path, False).encode(data, offs)
                ids = np.insert(ids, at[1:], end_id).astype("<u2")
                offsets = 2 * (at + np.arange(len(at)))
                cells = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.record_batch([batch.column(0)[i:j], cells], ["id", "ids"])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(VOCAB_CELLS, np.int64)
    for batch in batches:
        for cell in batch.column(0):
            counts += np.bincount(np.frombuffer(cell.as_buffer(), "<u2"), minlength=VOCAB_CELLS) if len(cell.as_buffer()) > 100_000 else 0
        small = [c.as_buffer() for c in batch.column(0) if len(c.as_buffer()) <= 100_000]
        counts += np.bincount(np.frombuffer(b"".join(small), "<u2"), minlength=VOCAB_CELLS)
    rows = list(sketch_rows(counts))
    if rows:
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["slice", "cells"])


def _write(folder: str, rank_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, names, cells, held = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(c) // 2 for c in cells], np.int64)
            path = f"{folder}/part-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.gtf"
            write_shard(path, names, lengths, rank_of[np.frombuffer(b"".join(cells), "<u2")])
            return pa.record_batch([pa.array([x], k) for x, k in ((part, pa.int64()), (seq, pa.int64()), (path, pa.string()), (len(names), pa.int64()), (held, pa.int64()))], ["part", "seq", "path", "n_docs", "n_ids"])

        for batch in batches:
            for name, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = cell.as_buffer()
                names.append(name)
                cells.append(b)
                held += len(b) // 2
                if held >= SHARD_IDS:
                    yield flush()
                    seq, names, cells, held = seq + 1, [], [], 0
        if names:
            yield flush()

    return run


def _read():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, named in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names, lengths, ranks = read_shard(path)
                ids = read_ranks(named)[ranks]
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch([pa.array(names, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    return run


@dataclass
class TokenFiles:
    """folder: ranks and shards; manifest: (path, start, n_docs, n_ids, ranks) of each shard."""

    folder: str
    manifest: DataFrame

    def read(self, id_col: str = "doc_id") -> DataFrame:
        """(id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
        # Told how many, Spark keeps as many tasks: by its bytes the manifest would fit one.
        tasks = max(1, -(-self.manifest.count() // SHARDS_A_TASK))
        rows = self.manifest.select("path", "start", "ranks").repartition(tasks, "path").mapInArrow(lean(_read(), tokens=True), "id long, start long, n_tokens long, ids_crc32 long")
        return rows.withColumnRenamed("id", id_col)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encodes every text, adds ``end_id`` to each and writes the files in ascending id order."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = folder or new_folder(spark, "token-files")
    system, name = fs.FileSystem.from_uri(folder)
    system.create_dir(name, recursive=True)
    ids = staged(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(_tokenize(tokenizer_path, end_id), tokens=True), "id long, ids binary"), "token-ids")
    counts = add_sketches(ids.select("ids").mapInArrow(lean(_frequencies, tokens=True), "slice int, cells binary"), VOCAB_CELLS)
    order = np.argsort(-counts, kind="stable").astype("<u4")
    rank_of = np.empty(VOCAB_CELLS, np.uint32)
    rank_of[order] = np.arange(VOCAB_CELLS)
    ranks = f"ranks-{uuid.uuid4().hex}.bin"
    with system.open_output_stream(f"{name}/{ranks}") as f:
        f.write(order.tobytes())
    # Rows that share an id, or null, are split by a hash of their ids and, if that is one too, anywhere.
    tied = ids.withColumn("tie", F.xxhash64("ids")).withColumn("row", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange("id", "tie", "row").sortWithinPartitions("id", "tie", "row").select("id", "ids")
    written = staged(dealt.mapInArrow(lean(_write(folder, rank_of), tokens=True), "part long, seq long, path string, n_docs long, n_ids long"), "token-manifest")
    unstage(ids)
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return TokenFiles(folder, written.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).withColumn("ranks", F.lit(f"{folder}/{ranks}")))
