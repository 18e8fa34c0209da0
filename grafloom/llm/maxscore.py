"""Exact top-k inner-product search by MaxScore over shards.

Every dimension is a term, with postings in each shard. A term's gain for a document is its product less
the least product in the shard, so gains are never negative and a shard bounds each of them. For one query
the terms are split: the non-essential ones have the smallest bounds, and together they cannot lift a
document over the threshold of the k best so far unless essential terms do. Essential postings are
traversed for the whole shard; only documents that the remaining bounds still allow are probed in the other
terms, in growing steps that tighten the candidates. Shards and blocks of queries meet as equal keys, and
the k best of each are merged by a top-k per query.

Defined cases: rows with a null id or a null, empty or non-finite vector take no part; queries meet only
vectors of their own length; repeated ids are separate candidates, a query meets every row of another id, and of
rows that share a query's id the one with the least vector asks; fewer than k candidates give fewer rows; extra columns are ignored; scores saturate at 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 16_384
QUERY_ROWS = 2_048
_HITS = "query_id long, vec_id long, score long"


def finite(vec: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("id").to_numpy()
    if not len(ids):
        return ids, np.zeros((0, 1))
    flat = pa.concat_arrays([c.flatten() for c in table.column("v").chunks])
    return ids, flat.to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: high scores first, then small ids."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= edge)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def search_shard(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The k best of one shard for each query, exactly."""
    out = []
    if not len(v) or not len(q):
        return out
    dims = v.shape[1]
    most = int(np.abs(v).max()) * int(np.abs(q).max()) * dims
    kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object  # floats below 2**53 are exact
    postings = np.ascontiguousarray(v.T).astype(kind)
    q = q.astype(kind)
    high, low = postings.max(1), postings.min(1)
    for name, vec in zip(q_ids.tolist(), q, strict=True):
        upper, lower = np.maximum(vec * high, vec * low), np.minimum(vec * high, vec * low)
        spread = upper - lower
        terms = np.argsort(-spread.astype(float), kind="stable")
        rest = np.append(np.cumsum(upper[terms][::-1])[::-1], 0)  # most that terms from here on can add
        least = np.append(np.cumsum(lower[terms][::-1])[::-1], 0)
        alive = np.flatnonzero(ids != name)
        if not len(alive):
            continue
        # A first threshold: full scores of the documents that the widest terms favour.
        lead = vec[terms[:4]] @ postings[terms[:4]][:, alive]
        seeds = alive[np.argpartition(-lead.astype(float), min(4 * k, len(alive) - 1))[: 4 * k]]
        full = vec @ postings[:, seeds]
        theta = np.sort(full)[-k] if len(full) >= k else None
        base = lower.sum()
        idle = np.cumsum(spread[terms][::-1])[::-1]
        essential = dims if theta is None else max(1, int(np.count_nonzero(base + idle > theta)))
        essential = max(min(essential, dims), dims // 4)
        first = terms[:essential]
        partial = vec[first] @ postings[first]
        partial = partial[alive]
        at, step = essential, 4
        while at < dims:
            if len(partial) >= k:  # k documents are sure of this much: the threshold rises as terms are probed
                sure = np.partition(partial, len(partial) - k)[len(partial) - k] + least[at]
                theta = sure if theta is None else max(theta, sure)
            if theta is not None:
                stay = partial + rest[at] >= theta
                alive, partial = alive[stay], partial[stay]
            more = terms[at : at + step]
            partial = partial + vec[more] @ postings[more][:, alive]
            at += step
            step *= 2
        for p in _top(partial, ids[alive], k):
            score = int(partial[p])
            out.append((name, int(ids[alive[p]]), max(-(1 << 63), min((1 << 63) - 1, score))))
    return out


def _cogrouped(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        hits = search_shard(*_matrix(left), *_matrix(right), k)
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*hits, strict=True) if hits else ([], [], []))], names=["query_id", "vec_id", "score"])

    return run


def deal(queries: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the keys block, shard and dim: query blocks go to every shard and shards to every block,
    so a task holds at most about SHARD_ROWS vectors and QUERY_ROWS queries. Of rows that share a query's id the one
    with the least vector asks."""
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    shards = max(1, -(-vectors.count() // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    left = queries.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    right = vectors.select("id", "v", F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("id", F.lit(7)), F.lit(shards)).cast("int").alias("shard"))
    return left, right


def top_k(vectors: DataFrame, query_filter: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): components become floor(scale x), the score is their inner product."""
    vec = F.col(vec_col)
    usable = vectors.filter(F.col(id_col).isNotNull() & finite(vec))
    whole = usable.select(F.col(id_col).cast("long").alias("id"), F.transform(vec, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"))
    asked = usable.filter(query_filter).select(F.col(id_col).cast("long").alias("id"), F.transform(vec, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"))
    left, right = deal(asked, whole)
    hits = left.groupBy("block", "shard", "dim").cogroup(right.groupBy("block", "shard", "dim")).applyInArrow(_cogrouped(k), _HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same search in DuckDB SQL: ten best, queries whose id is divisible by 100.
TOP_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable d ON d.vec_id <> q.vec_id AND len(d.v) = len(q.v)
  WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10
"""
