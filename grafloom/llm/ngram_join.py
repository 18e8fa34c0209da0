"""N-gram Jaccard self-join of documents, exact, and the components that its links make.

Method. The set of a text is reduced to 64-bit shingle hashes. Documents with one set form a class (size
and 128 bits of fingerprint), so copies are never paired.

1. Which classes can link at all. A link with a set of n shares at least ``ceil(t n)`` of them, so among its
   ``n - ceil(t n) + l`` first shingles (by hash, l about n / 8) it shares about 0.75 l with others' first ones.
   These shingles are dealt by hash, every batch of 16 MB of text naming each of its shingles once, and only
   the number of shared ones comes back. Classes below it, nearly all of a plain corpus, go no further.
2. Tiles. The classes left name all their shingles; each learns how many of them name it. A class's shared
   shingles are put in order of that number, rarest first; linked classes have one of the first
   ``n - ceil(t n) + 1`` in common. A tile is such a shingle and a size band (sizes of a band differ by less than
   the factor 1 / t; a class stands in its own band and the next). Tiles are joined into groups, which bundle the
   tiles of near copies. A group too large for one task is taken apart again tile by tile: tiles of the same classes
   count once, within each the classes meet by their bitmaps alone, and only pairs whose bit counts admit a link join
   their classes to smaller groups. Texts that merely share passages in a ring are left alone by that.
3. Pairs. The classes of a group meet in one task; a group that is still over ``UNIT_SHINGLES``, one of texts that all hang
   together by admitted pairs, is cut by size band into blocks, and blocks of one band or of neighbouring bands meet in
   pairs. Within, hashed parity bitmaps bound the overlap from above by bit counts, and the overlaps of what they
   let through are counted exactly, for all of a unit at once, along the sorted arrays' common elements.

So every link is found whatever its component, texts travel only to be read, and the copies of a batch's common
passage cost one record. Documented bound: the ids of step 2 are picked by a bit set of at most 32 MB, which
lets more rows pass, and drops none, when more than 30 million classes are left.

Defined cases: null or wordless text has an empty set, links with nothing and is its own component; a row
with a null id takes no part and keeps component null; rows that repeat an id count as one document when
components are formed; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .components import connected_components, local_components
from .shared import bounded_batches, id_filter, in_bits, in_filter, lean, spare, staged, unstage, with_columns

#: Text of a batch whose classes are known by short numbers, and the most classes in one.
BATCH_BYTES = 16 << 20
BATCH_CLASSES = (1 << 16) - 2
SLICE_ROWS = 1 << 14
_NO_CREDIT = (1 << 16) - 1
#: Shingles of a bucket, and classes and shingles of the classes that are compared in one task.
BUCKET_SHINGLES = 4_000_000
UNIT_CLASSES = 8192
UNIT_SHINGLES = 1 << 19


@dataclass
class NgramJoin:
    """documents: id, n_shingles, class_id (smallest id with the same set), component_id, n_links (the other rows
    that the row links with; 0 of a wordless text, null where the id is null) and text_component (a label of what
    its own text reaches by links alone); links: all linked pairs (a long, b long, shared long) of different
    sets, by class id, computed when asked for."""

    documents: DataFrame
    _links: Callable[[], DataFrame]

    @cached_property
    def links(self) -> DataFrame:
        return self._links()


def _fingerprints(sets: list[np.ndarray], salt: int = 0) -> np.ndarray:
    n = np.array([len(s) for s in sets], np.int64)
    at = np.append(0, np.cumsum(n))
    sums = np.append(np.uint64(0), np.cumsum(tk.mix(np.concatenate([*sets, np.zeros(0, np.uint64)]) ^ np.uint64(salt))))
    return tk.mix(sums[at[1:]] - sums[at[:-1]] + n.astype(np.uint64)).view(np.int64)


def _need(n: np.ndarray, percent: int) -> np.ndarray:
    """The least that a set of n shares with one it links with."""
    return (percent * n + 99) // 100


def _runs(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices of runs of given lengths that begin at given places."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)


def _cuts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values of a sorted array begin, and their lengths."""
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return at, np.diff(np.append(at, len(key)))


def _batch_key(seq: int) -> int:
    context = TaskContext.get()
    return ((context.partitionId() if context else 0) << 24) + seq


_SCAN = [("id", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("fp2", pa.int64()), ("batch", pa.int64()), ("place", pa.int32()), ("near", pa.int64()), ("bucket", pa.int64()), ("cells", pa.binary())]
_SCAN_TYPE = "id long, n long, fp long, fp2 long, batch long, place int, near long, bucket long, cells binary"


def _scan(k: int, percent: int, buckets: int):
    """Rows (id, text): a digest of each row, with the shared shingles that its own batch knows of (near), and the
    batch's first shingles by bucket (hash and place of the class; no place where the batch already knows)."""
    make = with_columns(_SCAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, size = 0, 0
        known: dict[tuple[int, int], int] = {}
        first: list[np.ndarray] = []
        held: list[tuple] = []

        def ship() -> Iterator[pa.RecordBatch]:
            batch = _batch_key(seq)
            h = np.concatenate([*first, np.zeros(0, np.uint64)])
            place = np.repeat(np.arange(len(first)), [len(x) for x in first])
            order = np.argsort(h)
            h, place = h[order], place[order]
            at, length = _cuts(h)
            many = np.repeat(length > 1, length)
            near = np.bincount(place[many], minlength=len(first) + 1)
            h, place = h[at], np.where(length > 1, _NO_CREDIT, place[at]).astype(np.uint16)
            for ids, n, fp, fp2, where in held:
                yield make(len(n), id=ids, n=n, fp=fp, fp2=fp2, batch=np.full(len(n), batch), place=where, near=near[where])
            bucket = ((h & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.uint32)
            order = np.argsort(bucket, kind="stable")
            h, place = (h[order] >> np.uint64(32)).astype(np.uint32), place[order]
            at, length = _cuts(bucket := bucket[order])
            for a in range(0, len(at), 4096):
                spans = list(zip(at[a : a + 4096].tolist(), (at + length)[a : a + 4096].tolist(), strict=True))
                yield make(len(spans), batch=np.full(len(spans), batch), bucket=bucket[at[a : a + 4096]], cells=[h[x:y].tobytes() + place[x:y].tobytes() for x, y in spans])

        for batch in batches:
            for i, j, data, offs in tk.byte_slices(batch.column(1), rows=SLICE_ROWS):
                if size >= BATCH_BYTES or len(first) + j - i > BATCH_CLASSES:
                    yield from ship()
                    seq, size, known, first, held = seq + 1, 0, {}, [], []
                sets = tk.shingle_sets(data, offs, k)
                n = np.array([len(s) for s in sets], np.int64)
                fp, fp2 = _fingerprints(sets), _fingerprints(sets, 0x5DEECE66D5DEECE6)
                ids = batch.column(0)[i:j]
                keep = n - _need(n, percent) + np.maximum(1, n // 8)
                where = np.full(j - i, -1, np.int32)
                for r in np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False) & (n > 0)).tolist():
                    key = int(fp[r]), int(fp2[r])
                    if key not in known:
                        known[key] = len(first)
                        first.append(sets[r][: keep[r]])
                    where[r] = known[key]
                held.append((ids, n, fp, fp2, where))
                size += len(data)
        if held:
            yield from ship()

    return run


def _credits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (batch, bucket, cells): of each batch the places whose shingles other batches name too, one entry a shingle."""
    hashes, places, owner, names = [], [], [], []
    for batch in batches:
        for name, bucket, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            count = len(cells) // 6
            hashes.append(np.frombuffer(cells, np.uint32, count).astype(np.uint64) | np.uint64((bucket & 0xFFFFFFFF) << 32))
            places.append(np.frombuffer(cells, np.uint16, count, 4 * count))
            owner.append(np.full(count, len(names), np.int32))
            names.append(name)
    if not names:
        return
    h = np.concatenate(hashes)
    hashes = []
    order = np.argsort(h)
    _, length = _cuts(h[order])
    shared = order[np.repeat(length > 1, length)]
    place, owner = np.concatenate(places)[shared], np.concatenate(owner)[shared]
    fit = place != _NO_CREDIT
    place, owner = place[fit], owner[fit]
    order = np.argsort(owner, kind="stable")
    place = place[order]
    at, length = _cuts(owner := owner[order])
    out = [(names[owner[a]], place[a : a + m].tobytes()) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
    for a in range(0, len(out), 4096):
        yield pa.record_batch([pa.array([x[0] for x in out[a : a + 4096]], pa.int64()), pa.array([x[1] for x in out[a : a + 4096]], pa.binary())], ["batch", "cells"])


def _judge(percent: int):
    """Rows (id, n, fp, fp2, batch, place, near, cells) sorted by batch, credits first: digests with whether they can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_now, sums = None, np.zeros(_NO_CREDIT + 1, np.int64)
        for batch in batches:
            names = batch.column("batch").to_numpy()
            at, length = _cuts(names)
            for a, m in zip(at.tolist(), length.tolist(), strict=True):
                part = batch.slice(a, m)
                if names[a] != batch_now:
                    batch_now = names[a]
                    sums[:] = 0
                told = part.column("cells").is_valid().to_numpy(zero_copy_only=False)
                for cells in part.column("cells").filter(pa.array(told)):
                    np.add.at(sums, np.frombuffer(cells.as_buffer(), np.uint16), 1)
                rest = part.filter(pa.array(~told))
                if rest.num_rows:
                    n = rest.column("n").to_numpy()
                    place = rest.column("place").to_numpy()
                    shared = rest.column("near").to_numpy() + sums[place]
                    # A partner may be smaller and name fewer.
                    least = np.maximum(1, _need(n, percent) // 8)
                    keep = (place >= 0) & (n > 0) & (shared >= least)
                    yield pa.record_batch([*(rest.column(c) for c in ("id", "n", "fp", "fp2")), pa.array(keep)], ["id", "n", "fp", "fp2", "keep"])

    return run


_CLASSES = "batch long, fps binary, ns binary, hashes binary"


def _class_rows(k: int, bits: np.ndarray):
    """Rows (id, text): batches of the classes whose id the bit set holds, each with all its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, size, met, held = 0, 0, set(), []

        def ship() -> pa.RecordBatch:
            return pa.record_batch(
                [pa.array([_batch_key(seq)], pa.int64()), *(pa.array([x], pa.binary()) for x in (np.array([x[0] for x in held], np.int64).tobytes(), np.array([len(x[1]) for x in held], np.int64).tobytes(), np.concatenate([x[1] for x in held]).tobytes()))],
                ["batch", "fps", "ns", "hashes"],
            )

        for batch in batches:
            known = in_bits(batch.column(0), bits)
            for _, _, data, offs in tk.byte_slices(batch.column(1).filter(pa.array(known))):
                sets = tk.shingle_sets(data, offs, k)
                for fp, s in zip(_fingerprints(sets).tolist(), sets, strict=True):
                    if len(s) and fp not in met:
                        met.add(fp)
                        held.append((fp, s))
                        size += 8 * len(s)
                if size >= BATCH_BYTES // 2:
                    yield ship()
                    seq, size, met, held = seq + 1, 0, set(), []
        if held:
            yield ship()

    return run


def _unpack(fps: bytes, ns: bytes, hashes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(fps, np.int64), np.frombuffer(ns, np.int64), np.frombuffer(hashes, np.uint64)


def _ask(buckets: int):
    """Each batch's distinct shingles with the number of its classes that hold them, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, fps, ns, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h, count = np.unique(_unpack(fps, ns, hashes)[2], return_counts=True)
                bucket = (h % np.uint64(buckets)).astype(np.uint32)
                order = np.argsort(bucket, kind="stable")
                h, count, bucket = h[order], count[order].astype(np.uint32), bucket[order]
                at, length = _cuts(bucket)
                for a in range(0, len(at), 4096):
                    spans = list(zip(at[a : a + 4096].tolist(), (at + length)[a : a + 4096].tolist(), strict=True))
                    yield pa.record_batch([pa.array(bucket[at[a : a + 4096]], pa.int64()), pa.array([name] * len(spans), pa.int64()), pa.array([h[x:y].tobytes() + count[x:y].tobytes() for x, y in spans], pa.binary())], ["bucket", "batch", "cells"])

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each batch those of its shingles that more than one class holds, with a level that grows with their number."""
    hashes, counts, owner, names = [], [], [], []
    for batch in batches:
        for name, cells in zip(batch.column("batch").to_pylist(), batch.column("cells").to_pylist(), strict=True):
            m = len(cells) // 12
            hashes.append(np.frombuffer(cells, np.uint64, m))
            counts.append(np.frombuffer(cells, np.uint32, m, 8 * m))
            owner.append(np.full(m, len(names), np.int32))
            names.append(name)
    if not names:
        return
    h = np.concatenate(hashes)
    hashes = []
    order = np.argsort(h)
    h = h[order]
    at, length = _cuts(h)
    total = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), at)
    level = np.repeat(np.minimum(255, np.floor(6 * np.log2(total))).astype(np.uint8), length)
    fit = np.flatnonzero(level > 0)
    h, level, owner = h[fit], level[fit], np.concatenate(owner)[order[fit]]
    order = np.argsort(owner, kind="stable")
    h, level = h[order], level[order]
    at, length = _cuts(owner := owner[order])
    out = [(names[owner[a]], h[a : a + m].tobytes() + level[a : a + m].tobytes()) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
    for a in range(0, len(out), 1024):
        yield pa.record_batch([pa.array([x[0] for x in out[a : a + 1024]], pa.int64()), pa.array([x[1] for x in out[a : a + 1024]], pa.binary())], ["batch", "cells"])


_TILES = [("fp", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary()), ("own", pa.binary()), ("root", pa.int64()), ("bucket", pa.int64()), ("tiles", pa.binary())]
_TILES_TYPE = "fp long, n long, hashes binary, own binary, root long, bucket long, tiles binary"


def _tiles(percent: int, buckets: int):
    """Rows (batch, cells, fps, ns, hashes) sorted by batch: the classes that still can link, with their shared
    shingles and tiles (own); the class each is grouped with (root); and the tiles of each root, by bucket."""
    make = with_columns(_TILES)

    def of_batch(answers: list[bytes], classes: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not classes or not answers:
            return
        sizes = [len(x) // 9 for x in answers]
        key = np.concatenate([np.frombuffer(x, np.uint64, m) for x, m in zip(answers, sizes, strict=True)])
        level = np.concatenate([np.frombuffer(x, np.uint8, m, 8 * m) for x, m in zip(answers, sizes, strict=True)])
        order = np.argsort(key)
        key, level = key[order], level[order]
        fps, ns, hashes = (np.concatenate(x) for x in zip(*(_unpack(*c) for c in classes), strict=True))
        row = np.repeat(np.arange(len(fps)), ns)
        at = np.minimum(np.searchsorted(key, hashes), len(key) - 1)
        fit = key[at] == hashes
        row, hashes, rank = row[fit], hashes[fit], level[at[fit]]
        shared = np.bincount(row, minlength=len(fps))
        alive = shared >= _need(ns, percent)
        fit = alive[row]
        row, hashes, rank = row[fit], hashes[fit], rank[fit]
        # Of the first n - need + 1 shingles the ones that nobody shares come first.
        slots = ns - _need(ns, percent) + 1 - (ns - shared)
        order = np.lexsort((hashes, rank, row))
        begin = np.append(0, np.cumsum(np.bincount(row, minlength=len(fps))))
        first = order[np.arange(len(row)) - begin[row[order]] < slots[row[order]]]
        band = np.floor(np.log(np.maximum(ns, 1)) / np.log(100 / percent) + 1e-9).astype(np.int64)
        who = np.repeat(row[first], 2)
        tile = tk.mix(np.repeat(hashes[first], 2) + (np.repeat(band[row[first]], 2) + np.tile([0, 1], len(first))).astype(np.uint64))
        mine, upto = tile, 2 * np.append(0, np.cumsum(np.bincount(row[first], minlength=len(fps))))
        order = np.argsort(tile, kind="stable")
        tile, who = tile[order], who[order]
        at, length = _cuts(tile)
        root = local_components(who, np.repeat(who[at], length), len(fps))
        live = np.flatnonzero(alive)
        for a in range(0, len(live), 4096):
            rows = live[a : a + 4096]
            yield make(len(rows), fp=fps[rows], n=ns[rows], root=fps[root[rows]], hashes=[hashes[begin[r] : begin[r + 1]].tobytes() for r in rows], own=[mine[upto[r] : upto[r + 1]].tobytes() for r in rows])
        tile, owner = tile[at], fps[root[who[at]]]
        bucket = (tile % np.uint64(buckets)).astype(np.uint32)
        order = np.argsort(bucket, kind="stable")
        tile, owner, bucket = tile[order], owner[order], bucket[order]
        at, length = _cuts(bucket)
        spans = list(zip(at.tolist(), (at + length).tolist(), strict=True))
        for a in range(0, len(spans), 4096):
            yield make(len(spans[a : a + 4096]), bucket=bucket[at[a : a + 4096]], tiles=[tile[x:y].tobytes() + owner[x:y].tobytes() for x, y in spans[a : a + 4096]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, answers, classes = None, [], []
        for batch in batches:
            for name, cells, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != now:
                    yield from of_batch(answers, classes)
                    now, answers, classes = name, [], []
                if cells is None:
                    classes.append(row)
                else:
                    answers.append(cells)
        yield from of_batch(answers, classes)

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tiles): edges (a, b) between the roots that share a tile."""
    tiles, roots = [], []
    for batch in batches:
        for cells in batch.column(0):
            m = len(cells.as_buffer()) // 16
            tiles.append(np.frombuffer(cells.as_buffer(), np.uint64, m))
            roots.append(np.frombuffer(cells.as_buffer(), np.int64, m, 8 * m))
    if tiles:
        tile, root = np.concatenate(tiles), np.concatenate(roots)
        order = np.argsort(tile, kind="stable")
        names, code = np.unique(root[order], return_inverse=True)
        at, length = _cuts(tile[order])
        label = local_components(code, np.repeat(code[at], length), len(names))
        apart = np.flatnonzero(label != np.arange(len(names)))
        if len(apart):
            yield pa.record_batch([pa.array(names[apart]), pa.array(names[label[apart]])], ["a", "b"])


def _shared_counts(sets: list[np.ndarray], left: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, counts): how many elements the sets from i on share with each set, for the first ``left`` sets.
    Elements of many sets are counted by a matrix product, the others along their lists of sets."""
    m = len(sets)
    _, el, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    often = df >= max(16, m // 16)
    some = often[el]
    dense = np.zeros((m, int(often.sum())), np.float32)
    dense[row[some], (np.cumsum(often) - 1)[el[some]]] = 1
    some = ~some & (df[el] > 1)
    row, el = row[some], el[some]
    order = np.argsort(el, kind="stable")
    posts, first, length = row[order], np.searchsorted(el[order], el), df[el]
    cost = np.cumsum(np.bincount(row, weights=length, minlength=m) + m)
    a = 0
    while a < left:
        b = min(left, max(a + 1, int(np.searchsorted(cost, (cost[a - 1] if a else 0) + 2_000_000, "right"))))
        lo, hi = np.searchsorted(row, [a, b])
        n = length[lo:hi]
        rare = np.bincount(np.repeat(row[lo:hi] - a, n) * m + posts[_runs(n, first[lo:hi])], minlength=(b - a) * m).reshape(b - a, m)
        yield a, rare + (dense[a:b] @ dense.T).astype(np.int64)
        a = b


def _admitted(sets: list[np.ndarray], n: np.ndarray, far: np.ndarray, left: int, across: bool, percent: int) -> np.ndarray:
    """For the first ``left`` sets against all: whether sizes and the bit counts of bitmaps admit a link, each pair once."""
    m = len(sets)
    width = min(1 << 13, max(tk.bitmap_width(len(s)) for s in sets))
    marks = np.zeros((m, width // 64), np.uint64)
    row = np.repeat(np.arange(m), own := np.array([len(s) for s in sets]))
    odd = np.bincount(row * width + ((np.concatenate(sets) >> np.uint64(20)) & np.uint64(width - 1)).astype(np.int64), minlength=m * width) & 1 if m * width <= 1 << 22 else None
    if odd is not None:
        marks = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64).reshape(m, -1)
    else:
        for r, s in enumerate(sets):
            bits = np.bincount((s >> np.uint64(20)).astype(np.int64) & (width - 1), minlength=width) & 1
            marks[r] = np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)
    fit = np.zeros((left, m), bool)
    step = max(1, (1 << 22) // max(1, m * marks.shape[1]))
    for a in range(0, left, step):
        b = min(left, a + step)
        apart = np.bitwise_count(marks[a:b, None] ^ marks[None]).sum(2, dtype=np.int64)
        bound = (own[a:b, None] + own - apart) // 2
        fit[a:b] = 100 * bound >= percent * (n[a:b, None] + n - bound)
    if across:
        return fit & far
    return fit & (np.arange(left)[:, None] < np.arange(m))


def _class_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (fp, own) to a row for each tile of a class."""
    for batch in batches:
        fps, own = batch.column(0).to_numpy(), [np.frombuffer(c.as_buffer(), np.int64) for c in batch.column(1)]
        for a in range(0, len(own), 256):
            part = own[a : a + 256]
            yield pa.record_batch([pa.array(np.concatenate(part)), pa.array(np.repeat(fps[a : a + 256], [len(x) for x in part]))], ["tile", "fp"])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (fp, n, hashes) to (fp, n, shared, bits): the bitmap of a class's shared shingles and their number."""
    for batch in batches:
        sets = [np.frombuffer(c.as_buffer(), np.uint64) for c in batch.column(2)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array([tk.bitmap(x).tobytes() for x in sets], pa.binary())], ["fp", "n", "shared", "bits"])


def _met(percent: int):
    """Rows (crowd, fp, n, shared, bits) sorted by crowd: edges (a, b) that join the classes of a crowd which admitted
    pairs hold together. A crowd over UNIT_CLASSES is joined as it is, and so are classes that are joined already."""

    def stars(label: dict, crowd: list[tuple]) -> Iterator[tuple[int, int]]:
        def find(x: int) -> int:
            while label.get(x, x) != x:
                label[x] = label.get(label[x], label[x])
                x = label[x]
            return x

        fps = [c[0] for c in crowd]
        if len({find(f) for f in fps}) == 1:
            return
        if len(crowd) > UNIT_CLASSES:
            pairs = [(fps[0], f) for f in fps[1:]]
        else:
            n, own = (np.array([c[i] for c in crowd], np.int64) for i in (1, 2))
            width = min(len(c[3]) for c in crowd)
            marks = np.array([tk.fold(np.frombuffer(c[3], np.uint8), width) for c in crowd]).view(np.uint64)
            pairs, step = [], max(1, (1 << 22) // max(1, len(crowd) * marks.shape[1]))
            for a in range(0, len(crowd), step):
                apart = np.bitwise_count(marks[a : a + step, None] ^ marks[None]).sum(2, dtype=np.int64)
                bound = (own[a : a + step, None] + own - apart) // 2
                i, j = np.nonzero(100 * bound >= percent * (n[a : a + step, None] + n - bound))
                keep = i + a < j
                x, y = i[keep] + a, j[keep]
                # Of the pairs of a stretch a forest is enough.
                least = local_components(x, y, len(crowd))
                pairs += [(fps[least[k]], fps[k]) for k in np.flatnonzero(least != np.arange(len(crowd))).tolist()]
        for x, y in pairs:
            p, q = find(x), find(y)
            if p != q:
                label[max(p, q)] = min(p, q)
                yield x, y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, crowd, label, out = None, [], {}, []
        for batch in batches:
            for name, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != now:
                    out += stars(label, crowd) if len(crowd) > 1 else ()
                    now, crowd = name, []
                    if len(label) > 1 << 18:  # what is known is only a short cut
                        label = {}
                crowd.append(row)
            if len(out) > 10_000:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])
                out = []
        out += stars(label, crowd) if len(crowd) > 1 else ()
        if out:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return run


def _apart(groups: DataFrame, tiles: DataFrame, percent: int) -> DataFrame:
    """``groups`` with those too large for one unit taken apart: their classes by the admitted pairs of their tiles."""
    sizes = groups.groupBy("group").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    large = staged(sizes.filter((F.col("m") > UNIT_CLASSES) | (F.col("s") > UNIT_SHINGLES)).select("group"), "ngram-large")
    if not large.take(1):
        return groups
    big = groups.join(large, "group", "left_semi")
    own = tiles.filter("bucket is null").join(big.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]).select("fp", "own")
    held = staged(own.mapInArrow(lean(_class_tiles), "tile long, fp long"), "ngram-held")
    # Tiles of the same classes are one crowd.
    crowds = held.groupBy("tile").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("y")).filter("m > 1")
    members = held.join(crowds, "tile").select(F.xxhash64("m", "x", "y").alias("crowd"), "fp").distinct()
    signed = big.select("fp", "n", "hashes").mapInArrow(lean(_signed), "fp long, n long, shared long, bits binary")
    met = members.join(signed, "fp").select("crowd", "fp", "n", "shared", "bits").repartition("crowd").sortWithinPartitions("crowd", "fp")
    joined = connected_components(met.mapInArrow(lean(_met(percent)), "a long, b long")).toDF("fp", "component")
    rest = groups.join(large, "group", "left_anti")
    return staged(rest.unionByName(big.join(joined, "fp").select(F.col("component").alias("group"), "fp", "n", "copies", "hashes")), "ngram-apart")


def _within(percent: int, each: bool):
    """Rows sorted by unit: key, copies, whether the class is of the second block, whether there are two, whether the
    unit is a whole group, size, shared shingles. All links of a unit: each pair (a, b, shared), or for each class the rows that it links
    with and the smallest key that it reaches here (key, links, label, whole)."""

    def links_of(rows: list[list]) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: (r[2], r[0]))
        keys, copies, n = (np.array([r[c] for r in rows], np.int64) for c in (0, 1, 5))
        far, across = np.array([r[2] for r in rows], bool), rows[0][3]
        left = int((~far).sum())
        if across and left in (0, len(rows)):
            return
        sets = [np.frombuffer(r[6], np.uint64) for r in rows]
        fit = _admitted(sets, n, far, left if across else len(rows), across, percent)
        some = np.flatnonzero(fit.any(0) | np.append(fit.any(1), np.zeros(len(rows) - len(fit), bool)))
        found = []
        if len(some):
            within = int(np.searchsorted(some, len(fit)))
            for a, shared in _shared_counts([sets[r] for r in some], within):
                mine = some[a : a + len(shared)]
                ok = fit[np.ix_(mine, some)] & (100 * shared >= percent * (n[mine, None] + n[some] - shared))
                i, j = np.nonzero(ok)
                found.append((mine[i], some[j], shared[i, j]))
        i, j, shared = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        if each:
            for a in range(0, len(i), 50_000):
                x, y = keys[i[a : a + 50_000]], keys[j[a : a + 50_000]]
                yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(shared[a : a + 50_000])], ["a", "b", "shared"])
            return
        links = np.zeros(len(keys), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        label = local_components(i, j, len(keys))
        least = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(least, label, keys)
        linked = np.flatnonzero(links)
        if len(linked):
            yield pa.record_batch([pa.array(keys[linked]), pa.array(links[linked]), pa.array(least[label[linked]]), pa.array([rows[0][4]] * len(linked), pa.bool_())], ["key", "links", "label", "whole"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []
        for batch in batches:
            for u, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if u != unit:
                    if len(rows) > 1:
                        yield from links_of(rows)
                    unit, rows = u, []
                rows.append(row)
        if len(rows) > 1:
            yield from links_of(rows)

    return run


def _units(groups: DataFrame, percent: int) -> DataFrame:
    """Rows (group, fp, n, copies, hashes) dealt to units: a whole group, or two blocks of one or neighbouring bands."""
    band = F.floor(F.log("n") / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    rows = groups.withColumn("band", band)
    sums = rows.groupBy("group", "band").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    blocks = F.greatest(F.ceil(F.col("m") / (UNIT_CLASSES / 2)), F.ceil(F.col("s") / (UNIT_SHINGLES / 2))).cast("int")
    # As many entries as there are bands, some fifty.
    sizes = sums.withColumn("blocks", blocks).groupBy("group").agg(F.sum("m").alias("m"), F.sum("s").alias("s"), F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("blocks"))
    sizes = sizes.filter("m > 1").select("group", "blocks", ((F.col("m") <= UNIT_CLASSES) & (F.col("s") <= UNIT_SHINGLES)).alias("whole"))
    rows = rows.join(sizes, "group")
    whole = rows.filter("whole").select(F.xxhash64("group").alias("unit"), "fp", "copies", F.lit(False).alias("far"), F.lit(False).alias("across"), "whole", "n", "hashes")
    own = F.struct("band", F.pmod(F.xxhash64("fp"), F.col("blocks")[F.col("band")]).cast("int").alias("block"))

    def blocks_of(step: int) -> Column:
        count = F.coalesce(F.col("blocks")[F.col("band") + step], F.lit(0))
        told = F.transform(F.sequence(F.lit(1), count), lambda i: F.struct((F.col("band") + step).alias("band"), (i - 1).cast("int").alias("block")))
        return F.when(count > 0, told).otherwise(F.array().cast("array<struct<band:int,block:int>>"))

    reach = [blocks_of(step) for step in (-1, 0, 1)]
    cut = rows.filter("not whole").withColumn("own", own).withColumn("other", F.explode(F.concat(*reach)))
    cut = cut.select(F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "fp", "copies", (F.col("own") > F.col("other")).alias("far"), (F.col("own") != F.col("other")).alias("across"), "whole", "n", "hashes")
    return whole.unionByName(cut)


def _tied(rows: DataFrame, least: DataFrame) -> DataFrame:
    """(label, least), where an id that stands on texts of several components makes them one."""
    ends = rows.filter("id is not null and label is not null").select("id", "label").distinct()
    low = ends.groupBy("id").agg(F.min("label").alias("low"))
    wide = connected_components(ends.join(low, "id").select(F.col("label").alias("a"), F.col("low").alias("b")))
    least = least.join(staged(wide, "ngram-wide").toDF("label", "wide"), "label", "left").withColumn("wide", F.coalesce("wide", "label"))
    return least.select("label", "wide").join(least.groupBy("wide").agg(F.min("least").alias("least")), "wide").select("label", "least")


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = tk.SHINGLE_WORDS, percent: int = 75) -> NgramJoin:
    """Links rows whose shingle sets have a Jaccard similarity of at least ``percent`` / 100; see the module."""
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    # 1. Which classes can link at all. A shingle takes some six bytes of text, and three eighths are named.
    text_bytes = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(parts, text_bytes // (16 * BUCKET_SHINGLES))
    scanned = staged(source.mapInArrow(lean(_scan(words, percent, buckets)), _SCAN_TYPE), "ngram-scan")
    credits = scanned.filter("bucket is not null").select("batch", "bucket", "cells").repartition(buckets, "bucket").mapInArrow(lean(_credits), "batch long, cells binary")
    rows = scanned.filter("bucket is null").select("id", "n", "fp", "fp2", "batch", "place", "near", F.lit(None).cast("binary").alias("cells"))
    told = credits.select(*(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("id", "n", "fp", "fp2")), "batch", F.lit(None).cast("int").alias("place"), F.lit(None).cast("long").alias("near"), "cells")
    judged = rows.unionByName(told).repartition("batch").sortWithinPartitions("batch", F.col("cells").isNull())
    digests = staged(judged.mapInArrow(lean(_judge(percent)), "id long, n long, fp long, fp2 long, keep boolean"), "ngram-digests")
    unstage(scanned)
    classes = digests.filter("n > 0 and id is not null").groupBy("fp", "fp2", "n").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.min("keep").alias("keep"))
    classes = staged(classes, "ngram-classes")

    # 2. Tiles of the classes that are left.
    left = classes.filter("keep")
    count, shingles = left.agg(F.count("*"), F.sum("n")).first()
    buckets = max(parts, (shingles or 0) // BUCKET_SHINGLES)
    sets = staged(source.mapInArrow(lean(_class_rows(words, id_filter(left.select("id"), count))), _CLASSES), "ngram-sets")
    asked = sets.mapInArrow(lean(_ask(buckets)), "bucket long, batch long, cells binary")
    answers = asked.repartition(buckets, "bucket").mapInArrow(lean(_answer), "batch long, cells binary")
    none = F.lit(None).cast("binary")
    both = sets.select("batch", none.alias("cells"), "fps", "ns", "hashes").unionByName(answers.select("batch", "cells", none.alias("fps"), none.alias("ns"), none.alias("hashes")))
    tiles = staged(both.repartition("batch").sortWithinPartitions("batch").mapInArrow(lean(_tiles(percent, buckets)), _TILES_TYPE), "ngram-tiles")
    unstage(sets)
    roots = tiles.filter("bucket is null")
    edges = tiles.filter("bucket is not null").select("bucket", "tiles").repartition(buckets, "bucket").select("tiles").mapInArrow(lean(_joined), "a long, b long")
    group = connected_components(edges).toDF("root", "group")

    # 3. Pairs of each group.
    named = roots.select("fp", "n", "hashes", "root").join(group, "root", "left").withColumn("group", F.coalesce("group", "root"))
    groups = named.join(classes.select("fp", "copies"), "fp").select("group", "fp", "n", "copies", "hashes").dropDuplicates(["fp"])
    groups = staged(groups, "ngram-groups")
    split = _apart(groups, tiles, percent)
    unstage(tiles)
    units = staged(_units(split, percent), "ngram-units")
    unstage(groups)

    def within(each: bool, schema: str) -> DataFrame:
        return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(lean(_within(percent, each)), schema)

    found = staged(within(False, "key long, links long, label long, whole boolean"), "ngram-links")
    sums = found.groupBy("key").agg(F.sum("links").alias("links"), F.min(F.when(F.col("whole"), F.col("label"))).alias("label"))
    cut = found.filter("not whole").select(F.col("key").alias("a"), F.col("label").alias("b"))
    named = classes.join(sums, F.col("fp") == F.col("key"), "left").drop("key")
    if cut.take(1):
        named = named.join(connected_components(cut).toDF("node", "wide"), F.col("fp") == F.col("node"), "left").withColumn("label", F.coalesce("wide", "label")).drop("node", "wide")
    named = named.select("fp", "fp2", "n", "copies", F.col("id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "fp").alias("label"))

    least = named.filter("links > 0").groupBy("label").agg(F.min("class_id").alias("least"))
    several = digests.filter("id is not null").groupBy("id").count().filter("count > 1").select("id")
    tied = bool(several.take(1))
    if tied:
        rows = digests.join(named, ["fp", "fp2", "n"], "left").select("id", "label")
        least = _tied(rows, named.groupBy("label").agg(F.min("class_id").alias("least")))
        named = named.join(least, "label", "left")
    else:  # most classes have no links: only the others look for the smallest id of their component
        alone = named.filter("links = 0").withColumn("least", F.col("class_id"))
        named = named.filter("links > 0").join(staged(least, "ngram-least"), "label").unionByName(alone)
    rows = digests.join(named, ["fp", "fp2", "n"], "left").withColumn("least", F.coalesce("least", "id"))
    if tied:  # a wordless text follows the other texts of its id
        rows = rows.join(rows.join(several, "id", "left_semi").groupBy("id").agg(F.min("least").alias("mine")), "id", "left").withColumn("least", F.least("least", "mine"))
    known = F.col("id").isNotNull()
    out = rows.select(
        "id",
        F.col("n").alias("n_shingles"),
        F.when(known, F.coalesce("class_id", "id")).alias("class_id"),
        F.when(known, F.col("least")).alias("component_id"),
        F.when(known, F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0))).alias("n_links"),
        F.when(known, F.col("label")).alias("text_component"),
        F.col("fp").alias("text_key"),
    )

    def links() -> DataFrame:
        names = classes.select(F.col("fp").alias("key"), "id")
        pairs = within(True, "a long, b long, shared long").join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b")
        return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared")

    return NgramJoin(out.withColumnRenamed("id", id_col), links)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = tk.SHINGLE_WORDS, percent: int = 75) -> DataFrame:
    """One row of each group of linked texts: that with the smallest id. Decided by row: another text under the same id
    stays if its own text is linked with none that goes before it. Rows with a null id and wordless rows stay; of
    rows that repeat id and text one stays. Only rows whose id is among those that lose a row are shuffled."""
    # A row without links stays; the first rows of the others are written down, so that a join with a hot group can be split.
    rows = ngram_jaccard_join(docs, id_col, text_col, words, percent).documents.filter("text_component is not null and n_links > 0").select(F.col(id_col).alias("id"), "text_component", F.col("text_key").alias("key"))
    rows = staged(rows.groupBy("id", "key", "text_component").agg(F.count("*").alias("times")), "ngram-rows")
    first = staged(rows.groupBy("text_component").agg(F.min(F.struct("id", "key")).alias("first")), "ngram-first")
    judged = rows.join(first, "text_component").select("id", "key", (F.struct("id", "key") == F.col("first")).alias("stays"), "times")
    judged = staged(judged.filter("not stays or times > 1"), "ngram-judged")
    bits = id_filter(judged.select("id"), judged.count())
    row_id, key, ident, text_key, stays = (spare(docs, x) for x in ("row_id", "key", "ident", "text_key", "stays"))
    names, ids = [f"`{c}`" for c in docs.columns], F.col(id_col).cast("long")
    touched = docs.withColumn(key, _text_key(words, bits)(ids, F.col(text_col).cast("string"))).filter(F.col(key).isNotNull()).withColumn(row_id, ids)
    judged = judged.toDF(ident, text_key, stays, "times").drop("times")
    decided = touched.join(judged, (F.col(row_id) == F.col(ident)) & (F.col(key) == F.col(text_key)), "left")
    plain, repeated = decided.filter(F.col(stays).isNull()), decided.filter(F.col(stays)).dropDuplicates([row_id, key])
    return docs.filter(~in_filter(bits)(ids)).unionByName(plain.select(*names)).unionByName(repeated.select(*names))


def _text_key(k: int, bits: np.ndarray):
    """The first half of the fingerprint of a text's set, for rows whose id the bit set holds."""

    @F.arrow_udf("long")
    def run(ids: pa.Array, texts: pa.Array) -> pa.Array:
        known = in_bits(ids, bits)
        parts = [_fingerprints(tk.shingle_sets(data, offs, k)) for _, _, data, offs in tk.byte_slices(texts.filter(pa.array(known)))]
        out = np.zeros(len(known), np.int64)
        out[known] = np.concatenate([*parts, np.zeros(0, np.int64)])
        return pa.array(out, pa.int64(), mask=~known)

    return run
