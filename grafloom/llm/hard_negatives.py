"""Hard negatives by a Voronoi-partitioned distributed kNN join on norm-augmented vectors.

Components become floor(scale x) and a row's score is its integer inner product with the anchor. With M the greatest
norm, a row (x, sqrt(M^2 - |x|^2)) and an anchor (q, 0) are |q|^2 + M^2 - 2 score apart, squared: the best scores are the
nearest rows. ``PIVOTS`` rows, drawn by hash, are pivots; every row falls to the cell of its nearest pivot and keeps its
distance to it, and a cell keeps its count and least and greatest distance, by label and over all. Anchors are grouped by
nearest pivot, as many groups as they fill with ``GROUP_CELLS`` components each, larger ones cut by hash.

1. Positives: an anchor's radius is the distance within which whole cells surely hold k others of its label. A row goes
   to the groups that it might serve: those where the gap between its distance and the group's distances to its cell's
   pivot is at most the greatest radius in the group.
2. Negatives: each positive's score gives a window of scores, so a ring of distances; whole cells within the ring may
   close it further. A row goes to the groups whose ring it may lie in.

The rows of a group meet its anchors in chunks of ``CHUNK_CELLS`` components, and an exact join there gives each
chunk's best; the best of an anchor are merged. Bounds only keep rows away that can't be among the answers, so the result is
exact; where distances are all alike (random vectors of many dimensions) they keep few away and the cost is that of all
pairs of anchors and rows. Bounded on the driver: the pivots.

Defined cases: rows with a null id or label, or a vector that is null, empty or holds a null or non-finite component take
no part; rows meet only those of their own length; a row of the anchor's id is neither its positive nor its negative; of
rows that share an anchor's id that with the least label and vector asks; repeated ids are separate rows; fewer rows
give fewer answers; a positive of negative score has no negatives; extra columns are ignored; scores saturate at 64
bits, and windows are taken of those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .maxscore import _top, finite
from .shared import lean, staged, unstage

PIVOTS = 64
GROUP_CELLS = 1 << 17
CHUNK_CELLS = 1 << 20
_BLOCK = 1 << 22
_LIMIT = (1 << 63) - 1
_ROWS = "id long, label long, dim int, kind string, v binary, cell int, r double"


def _vectors(kinds: list[str], cells: list[bytes], dim: int) -> np.ndarray:
    """Rows of whole numbers as doubles, which hold each exactly."""
    out = np.empty((len(cells), dim))
    for i, (kind, cell) in enumerate(zip(kinds, cells, strict=True)):
        out[i] = np.frombuffer(cell, kind)
    return out


def _packed(x: np.ndarray) -> tuple[str, list[bytes]]:
    most = np.abs(x).max(initial=0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return kind, [row.tobytes() for row in x.astype(kind)]


class Pivots:
    """Points (p, rest) that cells are named after; for vectors of another length they are cut or padded with zeros."""

    def __init__(self, rows: list[list[float]], square: float):
        self.rows, self.square = rows, square

    def matrix(self, dim: int) -> np.ndarray:
        out = np.zeros((len(self.rows), dim))
        for i, row in enumerate(self.rows):
            out[i, : min(dim, len(row))] = row[:dim]
        return out

    def distances(self, x: np.ndarray, lifted: bool) -> np.ndarray:
        """From rows (lifted by their norm) or anchors to every pivot."""
        p = self.matrix(x.shape[1])
        with np.errstate(over="ignore", invalid="ignore"):
            height = np.sqrt(np.maximum(0, self.square - (p * p).sum(1)))
            own = np.sqrt(np.maximum(0, self.square - (x * x).sum(1))) if lifted else np.zeros(len(x))
            flat = (x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * x @ p.T
            return np.sqrt(np.maximum(0, flat) + (own[:, None] - height) ** 2)

    @property
    def slack(self) -> float:
        return 1e-5 * float(np.sqrt(self.square)) + 1e-9


def _celled(pivots: Pivots, scale: int):
    """Rows (id, label, vec) to rows of whole numbers with cell and distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pa.compute.list_value_length(batch.column(2)).to_numpy()
            for dim in np.unique(size).tolist():
                part = batch.filter(pa.array(size == dim))
                x = np.floor(scale * part.column(2).flatten().to_numpy().reshape(-1, dim))
                far = pivots.distances(x, True)
                far = np.where(np.isnan(far), np.inf, far)
                cell = far.argmin(1)
                kind, v = _packed(x)
                n = len(x)
                yield pa.record_batch([*part.columns[:2], pa.array([dim] * n, pa.int32()), pa.array([kind] * n), pa.array(v, pa.binary()), pa.array(cell, pa.int32()), pa.array(far[np.arange(n), cell])], ["id", "label", "dim", "kind", "v", "cell", "r"])

    return run


def _near(pivots: Pivots, groups: int):
    """Anchors with their distances to the pivots and the nearest of the first ``groups``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                far = pivots.distances(_vectors(part.column("kind").to_pylist(), part.column("v").to_pylist(), dim), False)
                far = np.where(np.isnan(far), np.inf, far)
                yield pa.record_batch([*part.columns, pa.array(list(far)), pa.array(far[:, :groups].argmin(1), pa.int32())], [*part.schema.names, "far", "near"])

    return run


def _reached(far: np.ndarray, most: np.ndarray, count: np.ndarray, need: int) -> float:
    """The distance within which cells of these counts and greatest distances surely hold ``need`` rows; inf if all don't."""
    edge = far + most
    order = np.argsort(edge)
    enough = np.searchsorted(np.cumsum(count[order]), need)
    return float(edge[order[enough]]) if enough < len(order) else np.inf


def _positive_ring(pivots: Pivots, k: int):
    def ring(row: dict) -> tuple[float, float]:
        own = row["of_label"] or []
        at = [c["cell"] for c in own]
        return 0.0, _reached(np.array(row["far"])[at], np.array([c["most"] for c in own]), np.array([c["n"] for c in own]), k + row["own"])

    return ring


def _negative_ring(pivots: Pivots, most: int):
    def ring(row: dict) -> tuple[float, float]:
        x = _vectors([row["kind"]], [row["v"]], row["dim"])[0]
        total = float((x * x).sum()) + pivots.square
        far = np.array(row["far"])
        mine = {c["cell"]: c["n"] for c in row["of_label"] or []}
        cells = row["of_all"]
        at = np.array([c["cell"] for c in cells])
        count = np.array([c["n"] - mine.get(c["cell"], 0) for c in cells])
        high, low = np.array([c["most"] for c in cells]), np.array([c["least"] for c in cells])
        inner, outer = np.inf, 0.0
        for p in row["positives"]:
            lo, hi = window(p["score"])
            if lo > hi:
                continue
            with np.errstate(invalid="ignore"):
                first, last = np.sqrt(max(0.0, total - 2 * float(hi))), np.sqrt(max(0.0, total - 2 * float(lo)))
            inside = (np.maximum(far[at] - high, low - far[at]) > first + pivots.slack) & (far[at] + high < last - pivots.slack)
            closed = _reached(far[at][inside], high[inside], count[inside], most + row["own"])
            inner, outer = min(inner, first), max(outer, min(last, closed))
        return inner, outer

    return ring


def window(positive: int, least: int = 30, most: int = 90) -> tuple[int, int]:
    """The least and the greatest score of a negative: from ``least`` to ``most`` percent of the positive's."""
    return -(-least * positive // 100), most * positive // 100


def _with_rings(ring: Callable[[dict], tuple[float, float]], slack: float):
    """Anchors with inner and outer distance of what may serve them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rings = [ring(r) for r in batch.to_pylist()]
            keep = batch.select(["id", "label", "dim", "kind", "v", "near", "block", "far", "positives"])
            yield pa.record_batch([*keep.columns, pa.array([max(0.0, a - slack) for a, _ in rings], pa.float64()), pa.array([b + slack for _, b in rings], pa.float64())], [*keep.schema.names, "inner", "outer"])

    return run


_GROUP = ["dim", "near", "block"]
_POSITIVES = "array<struct<place:int,id:bigint,score:bigint>>"


def _met(rows: DataFrame, cells: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(anchors, rows) by group and chunk: every row goes to the groups that it might serve, to one chunk of each."""
    reach = anchors.select(*_GROUP, "inner", "outer", F.posexplode("far").alias("cell", "d")).groupBy(*_GROUP, "cell").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.min("inner").alias("inner"), F.max("outer").alias("outer"))

    def serves(least: Column, most: Column) -> Column:
        gap = F.greatest(F.col("low") - most, least - F.col("high"), F.lit(0.0))
        return (F.isnan(gap) | (gap <= F.col("outer"))) & ~(F.col("high") + most < F.col("inner"))

    held = reach.join(cells, ["dim", "cell"]).filter(serves(F.col("least"), F.col("most")))
    reach = staged(held.select(*_GROUP, "cell", "low", "high", "inner", "outer", "n"), "negative-reach")
    chunks = reach.groupBy(*_GROUP).agg(F.ceil(F.sum("n") * F.col("dim") / CHUNK_CELLS).cast("int").alias("chunks"))
    spread = anchors.join(chunks, _GROUP).select(*_GROUP, "id", "label", "kind", "v", "positives", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    dealt = rows.withColumn("turn", F.monotonically_increasing_id()).join(reach.drop("n").join(chunks, _GROUP), ["dim", "cell"]).filter(serves(F.col("r"), F.col("r")))
    return spread, dealt.select(*_GROUP, F.pmod("turn", "chunks").cast("int").alias("chunk"), "id", "label", "kind", "v")


def _side(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dim = table.column("dim")[0].as_py() if table.num_rows else 0
    return table.column("id").to_numpy(), table.column("label").to_numpy(), _vectors(table.column("kind").to_pylist(), table.column("v").to_pylist(), dim)


def _products(q: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(i, scores) of each anchor with all rows: in doubles where they are exact, else in Python integers, saturated."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 1 << 53:
        step = max(1, _BLOCK // max(1, len(x)))
        for a in range(0, len(q), step):
            for i, scores in enumerate(q[a : a + step] @ x.T):
                yield a + i, scores
        return
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    right = whole(x)
    for i, row in enumerate(whole(q)):
        yield i, np.array([max(-_LIMIT - 1, min(_LIMIT, int(v))) for v in right @ row], np.int64)


def _positives(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            names, labels, q = _side(left)
            ids, theirs, x = _side(right)
            for label in np.unique(labels).tolist():
                asks, mine = np.flatnonzero(labels == label), np.flatnonzero(theirs == label)
                for i, scores in _products(q[asks], x[mine]) if len(mine) else ():
                    name = names[asks[i]]
                    other = np.flatnonzero(ids[mine] != name)
                    out += [(int(name), int(ids[mine[other[p]]]), int(scores[other[p]])) for p in _top(scores[other], ids[mine[other]], k)]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], [], []))], names=["anchor_id", "positive_id", "score"])

    return run


def _negatives(most: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            names, labels, q = _side(left)
            ids, theirs, x = _side(right)
            told = left.column("positives").to_pylist()
            for i, scores in _products(q, x):
                windows = [(p, *window(p["score"])) for p in told[i]]
                windows = [w for w in windows if w[1] <= w[2]]
                if not windows:
                    continue
                fit = np.flatnonzero((theirs != labels[i]) & (ids != names[i]) & (scores <= max(w[2] for w in windows)) & (scores >= min(w[1] for w in windows)))
                near = scores[fit]
                for p, lo, hi in windows:
                    mine = np.flatnonzero((near >= lo) & (near <= hi))
                    out += [(int(names[i]), p["place"], p["id"], p["score"], int(ids[fit[mine[t]]]), int(near[mine[t]])) for t in _top(near[mine], ids[fit[mine]], most)]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([],) * 6)], names=["anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def mine(vectors: DataFrame, anchor_filter: Column, positives: int = 5, negatives: int = 10, scale: int = 256, pivots: int = PIVOTS, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor, told by a condition on
    the id, and each of its first ``positives`` rows of the same label the first ``negatives`` rows of another label whose
    score is 30 to 90 percent of the positive's. Higher scores come first, ties by id."""
    spark = vectors.sparkSession
    vec = F.col(vec_col)
    label = F.col("label") if label is None else label
    usable = vectors.filter(F.col(id_col).isNotNull() & label.isNotNull() & finite(vec))
    named = usable.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(vec, lambda x: x.cast("double")).alias("vec"), anchor_filter.alias("asks"))
    square = F.aggregate(F.transform("vec", lambda x: F.floor(scale * x).cast("double")), F.lit(0.0), lambda a, x: a + x * x)
    top = named.agg(F.max(square)).first()[0] or 0.0
    drawn = named.select("vec", F.xxhash64("id").alias("h"), "id").orderBy("h", "id", "vec").limit(pivots).collect()
    cut = Pivots([np.floor(scale * np.array(r["vec"])).tolist() for r in drawn] or [[0.0]], float(top))
    rows = staged(named.select("id", "label", "vec").mapInArrow(lean(_celled(cut, scale)), _ROWS), "negative-rows")
    asked = named.filter("asks").select("id").distinct().withColumn("asks", F.lit(True))

    # Anchors: the distance of each to the pivots, and its group.
    least = F.min(F.struct("label", "dim", "kind", "v")).alias("x")
    anchors = rows.join(asked, "id", "left_semi").groupBy("id").agg(least, F.count("*").alias("own")).select("id", "x.*", F.col("own").cast("int").alias("own"))
    anchors = staged(anchors, "negative-asks")
    size = anchors.agg(F.sum("dim")).first()[0] or 0
    groups = min(len(cut.rows), max(1, -(-size // GROUP_CELLS)))
    schema = "id long, label long, dim int, kind string, v binary, own int, far array<double>, near int"
    anchors = anchors.mapInArrow(lean(_near(cut, groups)), schema)
    blocks = anchors.groupBy("dim", "near").agg(F.ceil(F.count("*") * F.col("dim") / GROUP_CELLS).cast("int").alias("blocks"))
    anchors = anchors.join(blocks, ["dim", "near"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")

    # Cells by label and over all: at most as many entries as there are pivots.
    cells = staged(rows.groupBy("dim", "label", "cell").agg(F.count("*").alias("n"), F.min("r").alias("least"), F.max("r").alias("most")), "negative-cells")
    of_label = cells.groupBy("dim", "label").agg(F.collect_list(F.struct("cell", "n", "least", "most")).alias("of_label"))
    whole = cells.groupBy("dim", "cell").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    of_all = whole.groupBy("dim").agg(F.collect_list(F.struct("cell", "n", "least", "most")).alias("of_all"))
    anchors = staged(anchors.join(of_label, ["dim", "label"], "left").join(of_all, "dim").withColumn("positives", F.lit(None).cast(_POSITIVES)), "negative-anchors")
    ringed = f"id long, label long, dim int, kind string, v binary, near int, block int, far array<double>, positives {_POSITIVES}, inner double, outer double"

    def join(asks: DataFrame, ring: Callable, local: Callable, kind: str) -> DataFrame:
        asks = staged(asks.mapInArrow(lean(_with_rings(ring, cut.slack)), ringed), "negative-rings")
        left, right = _met(rows, whole, asks)
        key = [*_GROUP, "chunk"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(local, kind)

    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    found = join(anchors, _positive_ring(cut, positives), _positives(positives), "anchor_id long, positive_id long, score long")
    found = found.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= positives)
    told = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", F.col("positive_id").alias("id"), "score"))).alias("positives"))
    asks = staged(anchors.drop("positives").join(told.withColumnRenamed("anchor_id", "id"), "id"), "negative-windows")
    unstage(anchors)
    kind = "anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long"
    hits = join(asks, _negative_ring(cut, negatives), _negatives(negatives), kind)
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The same in DuckDB SQL, for tables whose ids are unique.
NEGATIVES_SQL = """
WITH usable AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, d.vec_id, a.label = d.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable a JOIN usable d ON d.vec_id <> a.vec_id AND len(d.v) = len(a.v)
  WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM scored WHERE same) x WHERE place <= 5),
fit AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM fit WHERE rank <= 10
"""
