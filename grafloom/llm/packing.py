"""Packing documents into sequences by cutting-stock column generation.

A document's ids (with its end id) are cut into pieces of the sequence length and a rest. Rests are
counted by length class (lengths rounded up to ``step`` tokens, longer ones to 2 or 4 steps); over that bounded histogram a linear program
chooses how often each pattern of classes is used: a revised simplex whose new columns are priced by an
unbounded-knapsack dynamic program. Counts are rounded down and what is left over, bounded by the number
of classes, goes into patterns by first-fit decreasing. Documents are ranked within their class and
rank r takes the r-th place that the patterns offer to the class, which is arithmetic on a table of
bounded size. Ranks are prefix sums over salted parts, so a hot length is no single task.

Defined cases: null text is the empty text, one piece with only the end id; rows with null or repeated ids
are packed row by row; extra columns are ignored; an empty table gives an empty result. A rerun gives the
same sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import bounded_batches, in_task, lean, staged
from .tokens import encoder

PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"
_RANK_ROWS = 500_000


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0)
            for i, j, data, offs in tk.byte_slices(batch.column(1)):
                ids, at = encoder(path, False).encode(data, offs)
                ids = np.insert(ids, at[1:], end_id).astype("<u4")
                at = at + np.arange(len(at))
                total = np.diff(at)
                count = -(-total // capacity)
                doc = np.repeat(np.arange(j - i), count)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * capacity
                length = np.minimum(capacity, total[doc] - start)
                a = at[doc] + start
                crc = [zlib.crc32(ids[x:y]) for x, y in zip(a.tolist(), (a + length).tolist(), strict=True)]
                whole = [zlib.crc32(ids[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.record_batch([names[i:j].take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total[doc], np.array(whole)[doc]))], ["id", "start", "length", "ids_crc32", "doc_tokens", "salt"])

    return run


def _length_class(units: Column, most: int) -> Column:
    """Units rounded up: to 2 beyond an eighth of the capacity, to 4 beyond a half, if the capacity allows."""
    if most % 32:
        return units
    return F.when(units <= most // 8, units).when(units <= most // 2, (F.ceil(units / 2) * 2).cast("int")).otherwise((F.ceil(units / 4) * 4).cast("int"))


def _best_pattern(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of classes 1..capacity (class b fills b units) of the greatest value."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        total = best[c - 1 :: -1][:c] + value[1 : c + 1]
        k = int(total.argmax())
        best[c], took[c] = (total[k], k + 1) if total[k] > best[c - 1] else (best[c - 1], 0)
    pattern, c = np.zeros(capacity + 1, np.int64), capacity
    while c > 0:
        pattern[took[c]] += took[c] > 0
        c -= max(1, int(took[c]))
    return float(best[capacity]), pattern


def cutting_stock(demand: np.ndarray, tolerance: float = 5e-4) -> list[tuple[np.ndarray, int]]:
    """Patterns (pieces of each class) and how often each is used; together they hold the demand exactly.

    ``demand[b]`` pieces fill b units of a sequence of ``len(demand) - 1`` units. Columns are generated
    until the program is within ``tolerance`` (or half a sequence) of a lower bound: the units asked for,
    or the objective divided by the best column's value.
    """
    capacity = len(demand) - 1
    classes = np.flatnonzero(demand)
    if not len(classes):
        return []
    m = len(classes)
    basis = np.zeros((m, m))
    basis[np.arange(m), np.arange(m)] = capacity // classes
    inverse = np.linalg.inv(basis)
    need = demand[classes].astype(float)
    x = inverse @ need
    bound = need @ classes / capacity
    for step in range(1, 60 * m + 200):
        dual = inverse.sum(0)
        value = np.full(capacity + 1, -1.0)
        value[classes] = dual
        gain, pattern = _best_pattern(value, capacity)
        bound = max(bound, x.sum() / gain)
        if gain <= 1 + 1e-6 or x.sum() - bound <= max(0.5, tolerance * bound):
            break
        column = pattern[classes].astype(float)
        move = inverse @ column
        up = move > 1e-9
        ratio = np.where(up, x / np.where(up, move, 1), np.inf)
        leave = int(ratio.argmin())
        basis[:, leave] = column
        pivot = inverse[leave] / move[leave]
        inverse -= np.outer(move, pivot)
        inverse[leave] = pivot
        if step % 200 == 0:
            inverse = np.linalg.inv(basis)
        x = np.maximum(inverse @ need, 0)
    left = demand.astype(np.int64).copy()
    used: list[tuple[np.ndarray, int]] = []
    for k in np.argsort(-x, kind="stable"):
        pattern = np.zeros(capacity + 1, np.int64)
        pattern[classes] = np.rint(basis[:, k]).astype(np.int64)
        held = pattern > 0
        times = int(min(np.floor(x[k] + 1e-7), (left[held] // pattern[held]).min()))
        if times > 0:
            used.append((pattern, times))
            left -= times * pattern
    return used + _first_fit(left)


def _first_fit(left: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """First-fit decreasing over counts: fill a sequence with the largest classes that fit and repeat it
    while the counts last."""
    capacity, left, used = len(left) - 1, left.copy(), []
    while left.any():
        pattern, room = np.zeros(capacity + 1, np.int64), capacity
        while room > 0:
            fits = np.flatnonzero((left - pattern)[: room + 1] > 0)
            if not len(fits):
                break
            b = int(fits[-1])
            k = min(room // b, int(left[b] - pattern[b]))
            pattern[b] += k
            room -= k * b
        held = pattern > 0
        times = int((left[held] // pattern[held]).min())
        used.append((pattern, times))
        left -= times * pattern
    return used


def _places(used: list[tuple[np.ndarray, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each class: where its ranks begin in each pattern that holds it, pieces a sequence, first sequence."""
    first = np.append(0, np.cumsum([t for _, t in used]))
    out: dict[int, list[tuple[int, int, int]]] = {}
    for (pattern, times), at in zip(used, first, strict=False):
        for b in np.flatnonzero(pattern):
            out.setdefault(int(b), []).append((int(pattern[b]) * times, int(pattern[b]), int(at)))
    return {b: (np.cumsum([r[0] for r in rows]), *(np.array(c) for c in list(zip(*rows, strict=True))[1:])) for b, rows in out.items()}


def _assign(places: dict[int, tuple[np.ndarray, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, rank = (np.asarray(batch.column(k)) for k in (5, 6))
            seq = np.zeros(len(cls), np.int64)
            for b in np.unique(cls):
                rows = np.flatnonzero(cls == b)
                ends, each, first = places[int(b)]
                k = np.searchsorted(ends, rank[rows], "right")
                begins = np.append(0, ends[:-1])
                seq[rows] = first[k] + (rank[rows] - begins[k]) // each[k]
            yield pa.record_batch([*(batch.column(k) for k in range(5)), pa.array(seq)], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"])

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 4096, step: int = 8, id_col: str = "doc_id", text_col: str = "text", keep_encoder: bool = True) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece. Workers keep the encoder for
    later tasks; without ``keep_encoder`` each task loads it, which takes more time and less memory."""
    if capacity % step:
        raise ValueError("capacity must be a multiple of step")
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = staged(source.mapInArrow(lean(_pieces(tokenizer_path, end_id, capacity), tokens=True, drop=not keep_encoder), PIECES), "pieces")
    pieces = pieces.withColumn("class", _length_class(F.ceil(F.col("length") / step).cast("int"), capacity // step))
    demand = np.zeros(capacity // step + 1, np.int64)
    for row in pieces.groupBy("class").count().collect():  # a row for each length class at most
        demand[row["class"]] = row["count"]
    places = _places(in_task(spark, cutting_stock, demand))

    parts = max(1, int(demand.max()) // _RANK_ROWS) * 8
    salted = pieces.withColumn("part", F.pmod(F.xxhash64("id", "salt"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("class", "part").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("class", "part").orderBy("id", "start", "ids_crc32", "doc_tokens", "length")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(base, ["class", "part"])
    placed = ranked.select("id", "start", "length", "ids_crc32", "doc_tokens", "class", (F.col("base") + F.col("rank")).alias("rank")).mapInArrow(lean(_assign(places), tokens=True), "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long")
    line = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(line), F.lit(0))).withColumnRenamed("id", id_col)
