"""Hashed text features: byte bigrams and trigrams, and whole words, of a whole text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import spare

GRAM_CELLS = 4096
WORD_CELLS = 4096
#: Documents of a batch that are turned into a dense matrix at once.
_ROWS = 256
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def hashed_counts(data: np.ndarray, offs: np.ndarray, words: bool) -> np.ndarray:
    """A row per text: square roots of hashed counts, scaled to length 1 in each of the two parts."""
    n = len(offs) - 1
    out = np.zeros((n, GRAM_CELLS + WORD_CELLS * words), np.float32)
    low = _LOWER[data]
    two = low[:-1] * np.uint32(0x9E3779B1) + low[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) + low[2:] * np.uint32(0x27D4EB2F)
    grams = [((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(20)).astype(np.int64) for h in (two, three)]
    hashes, at = tk.word_hashes(data, offs) if words else (None, None)
    for r in range(n):
        a, b = int(offs[r]), int(offs[r + 1])
        if b - a >= 2:
            part = np.sqrt(np.bincount(np.concatenate([grams[0][a : b - 1], grams[1][a : max(a, b - 2)]]), minlength=GRAM_CELLS))
            out[r, :GRAM_CELLS] = part / np.sqrt((part * part).sum())
        if words and at[r + 1] > at[r]:
            part = np.sqrt(np.bincount((hashes[at[r] : at[r + 1]] >> np.uint64(52)).astype(np.int64), minlength=WORD_CELLS))
            out[r, GRAM_CELLS:] = part / np.sqrt((part * part).sum())
    return out


def dense_batches(column: pa.Array, words: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    for i, j, data, offs in tk.byte_slices(column):
        for a in range(i, j, _ROWS):
            b = min(j, a + _ROWS)
            lo, hi = int(offs[a - i]), int(offs[b - i])
            yield a, b, hashed_counts(data[lo:hi], offs[a - i : b - i + 1] - lo, words)


def sparse_rows(words: bool, extra: list[tuple[str, pa.DataType]]):
    """For mapInArrow over (text, extra ...): (cells binary, values binary, extra ...), a few kB a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in dense_batches(batch.column(0), words):
                cells = [np.flatnonzero(row).astype("<u2") for row in x]
                kept = [row[c].astype("<f4") for row, c in zip(x, cells, strict=True)]
                yield pa.record_batch([pa.array([c.tobytes() for c in cells], pa.binary()), pa.array([v.tobytes() for v in kept], pa.binary()), *(batch.column(k + 1)[a:b].cast(t) for k, (_, t) in enumerate(extra))], ["cells", "vals", *(n for n, _ in extra)])

    return run


def dense_table(table: pa.Table, words: bool) -> np.ndarray:
    x = np.zeros((table.num_rows, GRAM_CELLS + WORD_CELLS * words), np.float32)
    for r, (c, v) in enumerate(zip(table.column("cells"), table.column("vals"), strict=True)):
        x[r, np.frombuffer(c.as_py(), "<u2")] = np.frombuffer(v.as_py(), "<f4")
    return x


#: Groups whose sizes are broadcast; the rows of any further group meet their size in a join.
SMALL_GROUPS = 10_000


def bounded_sample(rows: DataFrame, group: str, key: Column, most: int | None = None, total: int | None = None) -> DataFrame:
    """About ``most`` rows of each value of ``group`` (all, where there are fewer), chosen by a hash of ``key``;
    with ``total`` an equal part of it for each, one row at least. No value of ``group`` is left out."""
    size, draw = spare(rows, "size"), spare(rows, "draw")
    sizes = rows.groupBy(group).agg(F.count("*").alias(size))
    first = sizes.orderBy(F.desc(size), group).limit(SMALL_GROUPS)
    groups = sizes.count()
    if most is None:
        most = max(1, (total or 0) // max(1, groups))
    share = F.pmod(F.xxhash64(key, F.lit(29)), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.withColumn(draw, share)
    found = drawn.join(F.broadcast(first), group)
    if groups > SMALL_GROUPS:
        found = found.unionByName(drawn.join(F.broadcast(first), group, "left_anti").join(sizes, group))
    return found.filter(F.col(draw) < most / F.col(size)).select(*rows.columns)
