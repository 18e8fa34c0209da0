"""Approximate nearest neighbours by collision-counting hashing with query-centred windows.

A shard keeps, for each of ``PROJECTIONS`` seeded directions, one sorted array of the unit vectors'
projections. A query opens a window around its own projection in every array; the window's width grows by
virtual rehashing (the radius is multiplied, no table is built anew). A vector met in at least a share
``THRESHOLD`` of the windows is verified with the exact cosine. A query stops when k verified vectors lie
within the radius that its windows stand for, or when the share of the shard that ``verify_share`` gives for the
dimension (and at least ``VERIFY_LEAST`` vectors) has been verified: of the vectors that pass the threshold in the last
step those met in most windows, so that the share is kept. With ``share`` 1 all are verified, and the result is exact.
Equal vectors of a shard are one entry; of their ids the k + 1 smallest are kept, since no others can stand
among the k nearest. Every row is indexed.

Recall against brute force is measured in ``tests/llm``. Defined cases: rows with a null id or a null, zero
or non-finite vector take no part; queries meet only vectors of their own length; repeated ids are separate
candidates, and of rows that share a query's id the one with the least vector asks; fewer than k candidates give
fewer rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .maxscore import _matrix, deal, finite

PROJECTIONS = 80
THRESHOLD = 0.72
GROWTH = 1.12
#: The radius of the first windows; unit vectors are 2 apart at most.
FIRST_RADIUS = 0.9
#: Neighbours must lie this much within the radius before a query stops.
MARGIN = 1.2
VERIFY_LEAST = 400
_HITS = "query_id long, vec_id long, score double"


def verify_share(dim: int) -> float:
    """The share of a shard at which a query stops when none is given: 0.3 up to 64 components, then growing with the
    root of their number, all from about 700 on, since projections of long vectors tell ever less about distance."""
    return min(1.0, 0.3 * max(1.0, dim / 64) ** 0.5)


class Shard:
    """Single-projection sorted arrays of distinct vectors."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int, projections: int = PROJECTIONS, seed: int = 5):
        order = np.lexsort((ids, *v.T))
        v, ids = v[order], ids[order]
        new = np.append(True, (v[1:] != v[:-1]).any(1)) if len(v) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        # Of equal vectors the k + 1 smallest ids, of each of them k rows: others can't be among k nearest.
        other = new | np.append(True, ids[1:] != ids[:-1])[: len(ids)]
        count = np.cumsum(other)
        rank = count - count[np.flatnonzero(new)][group]
        turn = np.arange(len(v)) - np.flatnonzero(other)[count - 1]
        keep = (rank <= k) & (turn < k)
        self.v = v[new]
        self.ids, self.group = ids[keep], group[keep]
        self.begin = np.searchsorted(self.group, np.arange(len(self.v) + 1))
        self.norm = np.sqrt((self.v * self.v).sum(1))
        self.unit = self.v / self.norm[:, None]
        self.axes = np.random.default_rng(seed).standard_normal((v.shape[1], projections))
        self.axes /= np.sqrt((self.axes**2).sum(0))
        heights = (self.unit @ self.axes).T
        self.order = np.argsort(heights, axis=1).astype(np.int32)
        self.sorted = np.take_along_axis(heights, self.order, 1)

    def nearest(self, name: int, q: np.ndarray, k: int, threshold: float = THRESHOLD, share: float | None = None) -> list[tuple[int, int, float]]:
        """The k best (query, id, score); ``self.verified`` counts the vectors whose cosine was taken."""
        n = len(self.v)
        if not n:
            return []
        length = np.sqrt((q * q).sum())
        heights = (q / length) @ self.axes
        low = high = np.array([np.searchsorted(s, h) for s, h in zip(self.sorted, heights, strict=True)])
        hits = np.zeros(n, np.int16)
        seen = np.zeros(n, bool)
        share = verify_share(self.v.shape[1]) if share is None else share
        need, budget = int(np.ceil(threshold * len(self.sorted))), n if share >= 1 else max(VERIFY_LEAST, int(share * n))
        spread = 1 / np.sqrt(self.v.shape[1])
        radius, found, scores = FIRST_RADIUS, np.zeros(0, np.int64), np.zeros(0)
        while True:
            # Points at distance r project within r * spread of the query two times in three.
            half = radius * spread * 1.05
            lo = np.array([np.searchsorted(s, h - half) for s, h in zip(self.sorted, heights, strict=True)])
            hi = np.array([np.searchsorted(s, h + half, "right") for s, h in zip(self.sorted, heights, strict=True)])
            new = [o[a:b] for o, l0, h0, l1, h1 in zip(self.order, low, high, lo, hi, strict=True) for a, b in ((l1, l0), (h0, h1)) if b > a]
            low, high = lo, hi
            if new:
                hits += np.bincount(np.concatenate(new), minlength=n).astype(np.int16)
            fresh = np.flatnonzero((hits >= need) & ~seen)
            if len(found) + len(fresh) > budget:
                fresh = np.sort(fresh[np.argsort(-hits[fresh], kind="stable")][: budget - len(found)])
            seen[fresh] = True
            found = np.concatenate([found, fresh])
            scores = np.concatenate([scores, (self.v[fresh] * q).sum(1) / (self.norm[fresh] * length)])
            near = int((2 - 2 * scores <= (radius / MARGIN) ** 2).sum())
            if share < 1 and (near >= k + 1 and len(found) >= min(n, VERIFY_LEAST) or radius > 4) or len(found) >= min(n, budget):
                break
            radius *= GROWTH
        if len(found) < min(n, k + 1):  # windows over everything: all rows are met
            found = np.arange(n)
            scores = (self.v * q).sum(1) / (self.norm * length)
        self.verified = getattr(self, "verified", 0) + len(found)
        best = np.argsort(-scores, kind="stable")
        edge = scores[best[min(len(best), k + 1) - 1]]
        out = []
        for f in np.flatnonzero(scores >= edge):
            g = found[f]
            out += [(name, int(i), float(scores[f])) for i in self.ids[self.begin[g] : self.begin[g + 1]] if i != name]
        out.sort(key=lambda x: (-x[2], x[1]))
        return out[:k]


def _cogrouped(k: int, projections: int, threshold: float, share: float | None):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        hits = []
        names, q = _matrix(left)
        ids, v = _matrix(right)
        if len(names) and len(ids):
            shard = Shard(ids, v, k, projections)
            for name, vec in zip(names.tolist(), q, strict=True):
                hits += shard.nearest(name, vec, k, threshold, share)
        cols = zip(*hits, strict=True) if hits else ([], [], [])
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, query_filter: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", projections: int = PROJECTIONS, threshold: float = THRESHOLD, share: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by cosine, scores in double precision. ``share`` 1 is exact."""
    vec = F.col(vec_col)
    usable = vectors.filter(F.col(id_col).isNotNull() & finite(vec) & F.exists(vec, lambda x: x != 0))
    cols = (F.col(id_col).cast("long").alias("id"), F.transform(vec, lambda x: x.cast("double")).alias("v"))
    left, right = deal(usable.filter(query_filter).select(*cols), usable.select(*cols))
    hits = left.groupBy("block", "shard", "dim").cogroup(right.groupBy("block", "shard", "dim")).applyInArrow(_cogrouped(k, projections, threshold, share), _HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
