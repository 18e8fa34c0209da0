"""Exact centroid clustering (Lloyd's rounds on integers) by kd-tree filtering.

Vectors of ``dim`` finite components become floor(scale x). Each partition builds kd-trees of up to ``TREE_ROWS``
vectors once and writes them to the shared folder; a node holds its count, the integer sum of its vectors and its
box. A round walks each tree level by level with the few centroids: of a node's candidates the one nearest to the
box's middle stands, and a centroid that is farther than it from every point of the box is pruned (strictly, so that
ties stay open). A node with one candidate left is assigned whole by count and sum, a leaf's vectors are resolved by
their distances. Only sums by centroid leave the tasks, and they are added up in one task a centroid; the driver sees
k centroids. All arithmetic is exact: in 64 bits or doubles where the greatest component allows it, else in Python
integers.

Defined cases: rows with a null vector, another length or a null or non-finite component are left out; a row with a
null id is clustered but never an initial centroid; of rows that repeat an id each is a row of its own, and equal
hashes are put in order of the vectors; fewer than k rows to start from give fewer centroids; extra columns are ignored;
an empty table gives an empty result; distances and inertia beyond 64 bits saturate.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .maxscore import finite
from .shared import lean, staged, unstage

TREE_ROWS = 8_192
LEAF_ROWS = 64
_LONG = (1 << 63) - 1
_PARTS = "cluster int, count long, sums string"


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale x) exactly: int64, or Python integers where 64 bits wouldn't hold a squared distance."""
    y = np.floor(scale * x)
    room = 1 << (61 - max(1, x.shape[1] if x.ndim > 1 else 1).bit_length()) // 2
    if not y.size or np.abs(y).max() < room:
        return y.astype(np.int64)
    out = np.empty(y.shape, object)
    out.ravel()[:] = [int(v) for v in y.ravel()]
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    if x.dtype == object or not x.size:
        return x
    most = int(np.abs(x).max())
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def _wide(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else x.astype(np.int64)


@dataclass
class Tree:
    """Nodes in breadth-first order: child is the place of the first of two children or -1; [begin, end) are its rows."""

    ids: pa.Array
    points: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    @staticmethod
    def build(ids: pa.Array, points: np.ndarray, leaf: int = LEAF_ROWS) -> Tree:
        """Splits a node at the middle row of its widest component."""
        order = np.arange(len(points))
        begin, end, child, low, high, sums = [0], [len(points)], [], [], [], []
        at = 0
        while at < len(begin):
            a, b = begin[at], end[at]
            rows = points[order[a:b]]
            lo, hi = rows.min(0), rows.max(0)
            low.append(lo)
            high.append(hi)
            sums.append(_wide(rows).sum(0))
            axis = int(np.argmax(hi - lo))
            if b - a <= leaf or lo[axis] == hi[axis]:
                child.append(-1)
            else:
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argsort(rows[:, axis], kind="stable")]
                child.append(len(begin))
                begin += [a, a + mid]
                end += [a + mid, b]
            at += 1
        names = [np.array(x, np.int64) for x in (begin, end, child)]
        return Tree(ids.take(pa.array(order)), _narrow(points[order]), *names, _narrow(np.array(low)), _narrow(np.array(high)), np.array(sums))

    def walk(self, centres: np.ndarray) -> Iterator[tuple[int, np.ndarray | slice, np.ndarray | None, np.ndarray]]:
        """Every vector once: (cluster, rows, None, sum) of nodes that are assigned whole, and (-1, rows, clusters, []) of
        resolved leaves."""
        k = len(centres)
        own = (centres * centres).sum(1)
        level, open_ = np.array([0]), np.ones((1, k), bool)
        while len(level):
            low, high = _wide(self.low[level]), _wide(self.high[level])
            # Twice the distance to the middle, less what all centroids share.
            near = 4 * own - 4 * ((low + high) @ centres.T)
            near = np.where(open_, near, near.max() + 1)
            best = near.argmin(1)
            turn = centres[None] - centres[best][:, None]
            # The most by which the standing centroid is farther than another one, over the whole box.
            gain = 2 * np.where(turn > 0, turn * high[:, None], turn * low[:, None]).sum(2) + own[best][:, None] - own
            open_ &= gain >= 0
            alone = open_.sum(1) == 1
            for node, cluster in zip(level[alone].tolist(), open_[alone].argmax(1).tolist(), strict=True):
                yield cluster, slice(self.begin[node], self.end[node]), None, self.sums[node]
            leaf = ~alone & (self.child[level] < 0)
            if leaf.any():
                nodes = level[leaf]
                size = self.end[nodes] - self.begin[nodes]
                rows = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.begin[nodes], size)
                for a in range(0, len(rows), TREE_ROWS):
                    part = rows[a : a + TREE_ROWS]
                    yield -1, part, self._nearest(part, centres, own, np.repeat(open_[leaf], size, 0)[a : a + TREE_ROWS]), self.sums[:0]
            split = ~alone & ~leaf
            first = self.child[level[split]]
            level = np.stack([first, first + 1], 1).ravel()
            open_ = np.repeat(open_[split], 2, 0)

    def _nearest(self, rows: np.ndarray, centres: np.ndarray, own: np.ndarray, open_: np.ndarray) -> np.ndarray:
        x = _wide(self.points[rows])
        if x.dtype != object and float(np.abs(x).max(initial=0)) * float(np.abs(centres).max(initial=0)) * x.shape[1] < 1 << 51 and own.max() < 1 << 51:
            gap = own.astype(float) - 2 * (x.astype(float) @ centres.T.astype(float))  # all values below 2**53: exact
            return np.where(open_, gap, np.inf).argmin(1)
        gap = own - 2 * (x @ centres.T)
        return np.where(open_, gap, gap.max() + 1).argmin(1)  # pruned ones lose, ties go to the first


def _trees(dim: int, scale: int):
    """Rows (id, vector) to binaries of trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points, held = [], [], 0

        def plant() -> pa.RecordBatch:
            kind = object if any(p.dtype == object for p in points) else np.int64
            tree = Tree.build(pa.concat_arrays(ids), np.concatenate([p.astype(kind) for p in points]))
            return pa.record_batch([pa.array([pickle.dumps(tree)], pa.binary())], ["tree"])

        for batch in batches:
            for a in range(0, batch.num_rows, TREE_ROWS):
                part = batch.slice(a, TREE_ROWS)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                ids.append(part.column(0))
                points.append(whole_numbers(flat.reshape(-1, dim), scale))
                held += part.num_rows
                if held >= TREE_ROWS:
                    yield plant()
                    ids, points, held = [], [], 0
        if held:
            yield plant()

    return run


def _texts(sums: np.ndarray) -> str:
    return ",".join(str(int(x)) for x in sums)


def _numbers(text: str) -> list[int]:
    return [int(x) for x in text.split(",")]


def _sums(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = [0] * len(centres), [np.zeros(centres.shape[1], object) for _ in centres]
        for batch in batches:
            for cell in batch.column(0):
                tree = pickle.loads(cell.as_py())
                for cluster, rows, each, total in tree.walk(centres):
                    if each is None:
                        counts[cluster] += rows.stop - rows.start
                        sums[cluster] = sums[cluster] + total
                    else:
                        for c in np.unique(each).tolist():
                            mine = rows[each == c]
                            counts[c] += len(mine)
                            sums[c] = sums[c] + _wide(tree.points[mine]).sum(0)
        live = [c for c in range(len(centres)) if counts[c]]
        if live:
            yield pa.record_batch([pa.array(live, pa.int32()), pa.array([counts[c] for c in live], pa.int64()), pa.array([_texts(sums[c]) for c in live])], ["cluster", "count", "sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, count, sums) of whole clusters: one row each."""
    found: dict[int, tuple[int, list[int]]] = {}
    for batch in batches:
        for c, n, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            old = found.get(c, (0, [0] * (text.count(",") + 1)))
            found[c] = old[0] + n, [a + b for a, b in zip(old[1], _numbers(text), strict=True)]
    if found:
        yield pa.record_batch([pa.array(list(found), pa.int32()), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([_texts(v[1]) for v in found.values()])], ["cluster", "count", "sums"])


def _assigned(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                tree = pickle.loads(cell.as_py())
                cluster = np.zeros(len(tree.points), np.int32)
                for c, rows, each, _ in tree.walk(centres):
                    cluster[rows] = c if each is None else each
                gap = _wide(tree.points) - centres[cluster]
                far = [min(_LONG, int(d)) for d in (gap * gap).sum(1)]
                yield pa.record_batch([tree.ids, pa.array(cluster), pa.array(far, pa.int64())], ["id", "cluster", "distance"])

    return run


def _matrix(rows: list[list[int]]) -> np.ndarray:
    """Centroids as an array: 64 bits where their squares fit, else Python integers."""
    room = 1 << (61 - max(1, len(rows[0])).bit_length()) // 2 if rows else 1
    return np.array(rows, np.int64 if all(abs(x) < room for r in rows for x in r) else object)


@dataclass
class Clusters:
    """rows: (id, cluster, distance) of every vector; centroids: (cluster, centroid array, inertia)."""

    rows: DataFrame
    centroids: list[tuple[int, list[int], int]]

    @property
    def inertia(self) -> int:
        return sum(c[2] for c in self.centroids)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vec_col: str = "embedding") -> Clusters:
    """``rounds`` of assignment and floor(mean) from the ``k`` vectors with the smallest hash of seed and id, then one
    more assignment; of equally near centroids the first counts."""
    spark = vectors.sparkSession
    vec = F.col(vec_col)
    kept = vectors.filter(finite(vec) & (F.size(vec) == dim)).select(F.col(id_col).cast("long").alias("id"), F.transform(vec, lambda x: x.cast("double")).alias("v"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = kept.filter("id is not null").withColumn("place", order).orderBy("place", "v").limit(k)  # k rows reach the driver
    centres = _matrix([[int(x) for x in whole_numbers(np.array(r["v"]), scale)] for r in first.select("v").collect()])
    trees = staged(kept.mapInArrow(lean(_trees(dim, scale)), "tree binary"), "kd-trees")
    if not len(centres):
        return Clusters(trees.filter("false").selectExpr("cast(null as long) as id", "0 as cluster", "0L as distance"), [])
    for _ in range(rounds):
        parts = trees.mapInArrow(lean(_sums(centres)), _PARTS).repartition(k, "cluster").mapInArrow(_added, _PARTS)
        means = [[int(x) for x in c] for c in centres]
        for r in parts.collect():  # a row for each centroid
            means[r["cluster"]] = [x // r["count"] for x in _numbers(r["sums"])]
        centres = _matrix(means)
    rows = staged(trees.mapInArrow(lean(_assigned(centres)), "id long, cluster int, distance long"), "kd-assigned")
    unstage(trees)
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    return Clusters(rows, [(c, [int(x) for x in centre], sums.get(c, 0)) for c, centre in enumerate(centres)])


def clustered(vectors: DataFrame, id_col: str = "vec_id", **settings) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector."""
    found = cluster(vectors, id_col=id_col, **settings)
    table = [(c, min(_LONG, own), hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest()) for c, centre, own in found.centroids]
    facts = F.array(*(F.struct(F.lit(own).cast("long").alias("own"), F.lit(digest).alias("digest")) for _, own, digest in table)) if table else F.array(F.struct(F.lit(0).cast("long").alias("own"), F.lit("").alias("digest")))
    mine = F.element_at(facts, F.col("cluster") + 1)
    return found.rows.select(F.col("id").alias(id_col), "cluster", "distance", mine["own"].alias("cluster_inertia"), F.lit(min(_LONG, found.inertia)).cast("long").alias("inertia"), mine["digest"].alias("centroid_sha256"))


def cluster_sql(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same in DuckDB SQL, for tables whose ids are unique: a step for each round."""
    gap = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR))) - 1 AS INTEGER) AS k, v FROM kept WHERE vec_id IS NOT NULL ORDER BY k LIMIT {k})"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, v, best.k AS k, best.d AS d FROM (SELECT p.vec_id, p.v, min(struct_pack(d := CAST({gap} AS BIGINT), k := c.k)) AS best FROM kept p CROSS JOIN c{r} c GROUP BY p.vec_id, p.v) x)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT k, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS v FROM (
      SELECT k, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, {dim + 1}) t(i) GROUP BY k, i) y GROUP BY k) m ON m.k = c.k)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT a.vec_id, a.k AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.k = a.k
"""
