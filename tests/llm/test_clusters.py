"""Centroid clustering against plain rounds in Python integers."""

import hashlib
import random

import pytest

from grafloom.llm import kd_clusters
from grafloom.llm.registry import oracle_sql, queries

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, id int"


def plainly(rows, k=8, rounds=10, scale=1024, dim=4):
    """(id, cluster, distance), inertia by cluster and centroids."""
    kept = [(i, [int(scale * x // 1) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and x == x and abs(x) != float("inf") for x in v)]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in order[:k]]
    if not centres:
        return [], {}, []

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for n in range(len(centres)):
            mine = [v for (_, v), (_, c) in zip(kept, near, strict=True) if c == n]
            if mine:
                centres[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    near = assign()
    own = {n: sum(d for d, c in near if c == n) for n in range(len(centres))}
    return [(i, c, d) for (i, _), (d, c) in zip(kept, near, strict=True)], own, centres


def compare(spark, rows, **settings):
    df = spark.createDataFrame([(i, v, 1, "a", 2) for i, v in rows], SCHEMA).repartition(3)
    want, own, centres = plainly(rows, **settings)
    got = kd_clusters.clustered(df, dim=settings.get("dim", 4), k=settings.get("k", 8)).collect()
    assert sorted(map(str, ((r.vec_id, r.cluster, r.distance) for r in got))) == sorted(map(str, ((i, c, min(d, 2**63 - 1)) for i, c, d in want)))
    for r in got:
        assert r.cluster_inertia == min(own[r.cluster], 2**63 - 1) and r.inertia == min(sum(own.values()), 2**63 - 1)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()


def test_clusters(spark, monkeypatch):
    """Blobs that whole nodes fall into, copies of one vector, ties on a grid, and rows that are left out."""
    rng = random.Random(4)
    rows = [(i, [rng.gauss(5 * (i % 6), 0.1) for _ in range(4)]) for i in range(600)]
    rows += [(1000 + i, [0.25, 0.5, -0.5, 1.0]) for i in range(300)] + [(2000 + i, [float(i % 2), float(i // 2 % 2), 0.0, 0.0]) for i in range(64)]
    rows += [(3000, None), (3001, [1.0]), (3002, []), (3003, [1.0, None, 0.0, 0.0]), (3004, [float("nan")] * 4), (3005, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (5, rows[5][1]), (7, [9.0, 9.0, 9.0, 9.0])]
    monkeypatch.setattr(kd_clusters, "TREE_ROWS", 150)
    compare(spark, rows)


def test_edges(spark):
    compare(spark, [])
    compare(spark, [(None, [1.0] * 4), (1, None)])
    compare(spark, [(i, [float(i)] * 4) for i in range(3)])
    compare(spark, [(i, [1e30 * (i % 5), -1e30 * (i % 3), 1e300, 0.1]) for i in range(40)])


def test_most_nodes_are_pruned():
    """On blobs apart from each other hardly a leaf is opened."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    points = (rng.integers(0, 8, 8000)[:, None] * 10_000 + rng.integers(-50, 50, (8000, 8))).astype(np.int64)
    tree = kd_clusters.Tree.build(pa.array(range(8000)), points)
    centres = np.arange(8)[:, None] * 10_000 + np.zeros((8, 8), np.int64)
    opened = sum(len(rows) for _, rows, each, _ in tree.walk(centres) if each is not None)
    assert opened < 1200
    seen = sum(rows.stop - rows.start for _, rows, each, _ in tree.walk(centres) if each is None)
    assert seen + opened == 8000


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query_equals_sql(spark, folder):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    got = queries()["op11_clusters"](spark, folder)
    want = con.sql(oracle_sql()["op11_clusters"])
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.select(*names).fetchall())
