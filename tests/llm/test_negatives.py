"""Hard negatives against plain loops."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from grafloom.llm import hard_negatives
from grafloom.llm.registry import oracle_sql, queries

SCHEMA = "vec_id long, embedding array<double>, label int, cell string, id int, n int"
MOST = 2**63 - 1


def plainly(rows, step=10, k=5, most=10):
    usable = [(i, y, tuple(int(256 * x // 1) for x in v)) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and x == x and abs(x) != float("inf") for x in v)]
    asks = {}
    for i, y, v in usable:
        if i % step == 0:
            asks[i] = min(asks.get(i, (y, v)), (y, v), key=lambda t: (t[0], len(t[1])))
    out = []
    for i, (y, v) in asks.items():
        score = lambda w: max(-MOST - 1, min(MOST, sum(a * b for a, b in zip(v, w, strict=True))))  # noqa: E731, B023
        same = sorted((-score(w), j) for j, z, w in usable if j != i and z == y and len(w) == len(v))[:k]
        other = [(score(w), j) for j, z, w in usable if j != i and z != y and len(w) == len(v)]
        for p, j in same:
            fit = sorted((-s, n) for s, n in other if 30 * -p <= 100 * s <= 90 * -p)[:most]
            out += [(i, j, r + 1, n, -p, -s) for r, (s, n) in enumerate(fit)]
    return out


def compare(spark, rows):
    df = spark.createDataFrame([(i, v, y, "a", 1, 2) for i, v, y in rows], SCHEMA).repartition(3)
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == sorted(plainly(rows))


def some(seed, n, dim, spread):
    """Blobs of several labels in each."""
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(middles)], rng.randint(0, 3)) for i in range(n)]


def test_negatives(spark, monkeypatch):
    rows = some(3, 260, 6, 0.15) + [(1000 + i, [0.5] * 6, i % 4) for i in range(60)]
    rows += [(2000, None, 1), (2010, [1.0] * 6, None), (2020, [], 2), (2030, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (2040, [float("nan")] * 6, 1), (2050, [float("-inf")] * 6, 1), (None, [1.0] * 6, 1)]
    rows += [(3000 + i, [0.1 * i, 1.0], i % 2) for i in range(25)] + [(20, rows[20][1], rows[20][2])] * 4 + [(31, rows[30][1], rows[30][2])] * 3 + [(4000, [-1.0] * 6, 9), (4001, [1.0] * 6, 9), (4002, [0.0] * 6, 9), (4010, [0.0] * 6, 9)]
    compare(spark, rows)
    monkeypatch.setattr(hard_negatives, "GROUP_CELLS", 30)  # groups, cut by hash, and chunks
    monkeypatch.setattr(hard_negatives, "CHUNK_CELLS", 300)
    monkeypatch.setattr(hard_negatives, "PIVOTS", 8)
    compare(spark, rows)


def test_edges(spark):
    compare(spark, [])
    compare(spark, [(0, [1.0, 2.0], 1)])
    compare(spark, [(i, [float(i), 1.0], 1) for i in range(12)])
    compare(spark, [(i, [1e200 * (i % 3), -1e160, float(i)], i % 2) for i in range(24)])
    compare(spark, [(i, [3e6 * (i % 7), 1e7 + i, 5e6], i % 3) for i in range(60)])


def test_bounds_keep_rows_away(spark, monkeypatch):
    """With blobs far apart a row goes to few of the groups."""
    rng = random.Random(1)
    rows = [(i, [50.0 * (i % 8 == b) + rng.gauss(0, 0.2) for b in range(8)], i // 8 % 3) for i in range(1600)]
    monkeypatch.setattr(hard_negatives, "GROUP_CELLS", 64)
    seen, met = [], hard_negatives._met

    def watched(rows, cells, anchors):
        left, right = met(rows, cells, anchors)
        seen.append((right.count(), anchors.select("dim", "near", "block").distinct().count()))
        return left, right

    monkeypatch.setattr(hard_negatives, "_met", watched)
    compare(spark, rows)
    assert all(groups >= 8 and copies < 0.35 * groups * len(rows) for copies, groups in seen)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query_equals_sql(spark, folder):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    got, want = queries()["op12_hard_negatives"](spark, folder), con.sql(oracle_sql()["op12_hard_negatives"])
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.select(*names).fetchall())
