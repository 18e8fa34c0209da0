"""The graph payload as JSON, and the shape in which results leave the engine."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def result(value: list | dict) -> dict:
    """A list as ``{"result": [...]}``, a dict as it is."""
    return {"result": value} if isinstance(value, list) else value


#: Rows of an answer that may come to the driver, and of a payload that may be one text.
ANSWER_ROWS = 100_000
TEXT_ROWS = 1_000_000


def rows_of(df: DataFrame, most: int = ANSWER_ROWS) -> list[dict]:
    """Rows of an answer as dicts; an error if there are more than ``most``, which are to be read as a frame."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: read them as a frame")
    return [r.asDict(recursive=True) for r in rows]


def write_payload(nodes: DataFrame, links: DataFrame, repos: DataFrame, stats: DataFrame, folder: str) -> None:
    """A folder with JSON lines of each part. Nothing passes the driver."""
    for name, df in (("nodes", nodes), ("links", links), ("repos", repos), ("stats", stats)):
        df.write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}")


def payload_json(nodes: DataFrame, links: DataFrame, repos: DataFrame, stats: DataFrame) -> DataFrame:
    """One row ``payload``: ``{nodes, links, repos, stats}`` as text; an error beyond ``TEXT_ROWS`` nodes and links, which
    ``write_payload`` puts out in parts."""
    told = stats.select((F.col("nodes") + F.col("links")).alias("n")).first()["n"]
    if told > TEXT_ROWS:
        raise ValueError(f"{told} nodes and links are too many for one text: use write_payload")
    one = None
    for name, df in (("nodes", nodes), ("links", links), ("repos", repos)):
        part = df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))
        one = part if one is None else one.crossJoin(part)  # one row each
    one = one.crossJoin(stats.select(F.struct(*stats.columns).alias("stats")))
    return one.select(F.to_json(F.struct("nodes", "links", "repos", "stats"), {"ignoreNullFields": "false"}).alias("payload"))


def parse(text: str) -> dict:
    return json.loads(text)
