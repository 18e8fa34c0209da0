"""Call-path trace (depth-first, with the model's caps) and reach (breadth-first, an extension).

A trace visits at most 500 nodes and looks at 51 neighbours of each, since it never needs a 52nd. So it asks
the edges for the neighbours of the names it has met, cut to 51 in the tasks, and walks on the driver: what
reaches it is bounded by the caps, however large the graph is.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..plans.staging import staged

TRACE = "ordinal int, parent_ordinal int, qualified_name string, level int, is_cycle boolean, nodes_visited int, truncated boolean"


def calls(edges: DataFrame, direction: str, repo: str | None) -> DataFrame:
    """(a, b) along ``direction`` over resolved calls."""
    if direction not in ("callees", "callers"):
        raise ValueError("direction must be 'callees' or 'callers'")
    own = edges.filter("edge_type = 'CALLS' and resolved = 1")
    own = own if repo is None else own.filter(F.col("repo") == repo)
    a, b = ("src_qname", "dst_qname") if direction == "callees" else ("dst_qname", "src_qname")
    return own.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()


def reach(edges: DataFrame, root: str, direction: str = "callees", depth: int = 3, repo: str | None = None) -> DataFrame:
    """(qualified_name, depth): all nodes within ``depth`` hops at their least distance, the root at 0. The calls
    are written down once; each hop then reads two columns of them."""
    step = staged(calls(edges, direction, repo), "calls")
    spark = edges.sparkSession
    seen = spark.createDataFrame([(root, 0)], "qualified_name string, depth int")
    front = seen
    for level in range(1, max(1, min(depth, S.MAX_DEPTH)) + 1):
        new = step.join(front.select(F.col("qualified_name").alias("a")), "a", "left_semi").select(F.col("b").alias("qualified_name")).distinct().join(seen, "qualified_name", "left_anti").withColumn("depth", F.lit(level))
        front = staged(new, "reach")
        if not front.take(1):
            break
        seen = seen.unionByName(front)
    return seen


def neighbours_of(step: DataFrame, names: list[str]) -> dict[str, list[str]]:
    """The first 51 neighbours in order of at most 501 names: a bounded answer, kept sorted and cut in the tasks."""
    first = F.slice(F.array_sort(F.collect_list("b")), 1, S.MAX_BREADTH + 1)
    order = Window.partitionBy("a").orderBy("b")
    near = step.filter(F.col("a").isin(names)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= S.MAX_BREADTH + 1)
    return {r["a"]: r["n"] for r in near.groupBy("a").agg(first.alias("n")).collect()}


def walk(root: str, neighbours: dict[str, list[str]], depth: int) -> tuple[list[tuple], int, bool]:
    """Pre-order rows (ordinal, parent, name, level, is_cycle), nodes visited without the root, truncated."""
    rows, visited, cut = [(0, None, root, 0, False)], {root}, False
    stack = [(0, root, 0, iter(neighbours.get(root, ())), [0])]
    while stack:
        parent, _, level, rest, children = stack[-1]
        name = next(rest, None)
        if name is None or level >= depth:
            stack.pop()
            continue
        if children[0] >= S.MAX_BREADTH or len(visited) - 1 >= S.MAX_TRACE_NODES:
            cut = True
            stack.pop()
            continue
        children[0] += 1
        again = name in visited
        rows.append((len(rows), parent, name, level + 1, again))
        if not again:
            visited.add(name)
            if level + 1 < depth:
                stack.append((len(rows) - 1, name, level + 1, iter(neighbours.get(name, ())), [0]))
    return rows, len(visited) - 1, cut


def trace_call_path(edges: DataFrame, root: str, direction: str = "callees", depth: int = 3, repo: str | None = None) -> DataFrame:
    """Rows of the depth-first tree. The walk is replayed over the neighbours known so far; names that it visits
    and that have not been looked up are asked for together, until nothing is missing. A walk visits at most 500
    nodes, so each question is about 501 names at most and there are at most ``depth`` + a few of them."""
    depth = max(1, min(int(depth), S.MAX_DEPTH))
    step = staged(calls(edges, direction, repo), "calls")
    known: dict[str, list[str]] = {}
    ask = [root]
    while ask:
        known |= dict.fromkeys(ask, []) | neighbours_of(step, ask)
        rows, n, cut = walk(root, known, depth)
        ask = list(dict.fromkeys(name for _, _, name, level, again in rows if not again and level < depth and name not in known))
    return edges.sparkSession.createDataFrame([(*r, n, cut) for r in rows], TRACE)


def tree_json(rows: Iterator) -> dict:
    """The nested tree of a trace's rows (at most 25,000), on the driver."""
    made: dict[int, dict] = {}
    for r in sorted(rows, key=lambda r: r["ordinal"]):
        node = {"qualified_name": r["qualified_name"], "children": []} | ({"cycle": True} if r["is_cycle"] else {})
        made[r["ordinal"]] = node
        if r["parent_ordinal"] is not None and r["ordinal"] > 0:
            made[r["parent_ordinal"]]["children"].append(node)
    return made[0]
