"""The daily schedule and requests from the app as streams.

``spark.readStream.format("ticks")`` is a source whose offset is the number of the last time that has come: times are
``every`` seconds apart from ``start``. Times that were missed while no query ran are made up by one row, the last of
them, with how many were missed before it. A new query begins with the next time to come.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..jobs import JobLog

DAY = 86_400
TICKS = "tick long, due timestamp, missed long"
REQUESTS = "id string, body string, stamp string, signature string"


class _Span(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class _Reader(DataSourceStreamReader):
    def __init__(self, start: int, every: int, clock: str | None):
        self.start, self.every, self.clock = start, every, clock

    def _now(self) -> float:
        if self.clock is None:
            return time.time()
        with open(self.clock, encoding="ascii") as f:
            return float(f.read())

    def _last(self) -> int:
        return int((self._now() - self.start) // self.every)

    def initialOffset(self) -> dict:
        return {"tick": self._last()}

    def latestOffset(self) -> dict:
        return {"tick": self._last()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Span(start["tick"], end["tick"])] if end["tick"] > start["tick"] else []

    def read(self, partition: _Span) -> Iterator[tuple]:
        from datetime import UTC, datetime

        due = datetime.fromtimestamp(self.start + partition.last * self.every, UTC)
        yield partition.last, due, partition.last - partition.first - 1

    def commit(self, end: dict) -> None:
        pass


class Ticks(DataSource):
    """Options: ``start`` (seconds since 1970, 0), ``every`` (seconds, a day), ``clock`` (a file that tells the time instead
    of the machine's clock)."""

    @classmethod
    def name(cls) -> str:
        return "ticks"

    def schema(self) -> str:
        return TICKS

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(int(self.options.get("start", 0)), int(self.options.get("every", DAY)), self.options.get("clock"))


def ticks(spark: SparkSession, start: int = 0, every: int = DAY, clock: str | None = None) -> DataFrame:
    """The stream of times that have come."""
    spark.dataSource.register(Ticks)
    reader = spark.readStream.format("ticks").option("start", start).option("every", every)
    return (reader.option("clock", clock) if clock else reader).load()


def daily(times: DataFrame, log: JobLog, checkpoint: str, **trigger) -> StreamingQuery:
    """Runs the job log's schedule at each time. A batch that is delivered again queues nothing twice, as a repository
    has one queued job at most."""

    def work(batch: DataFrame, _: int) -> None:
        for row in batch.select("due").collect():  # one
            log.on_schedule(F.lit(row["due"]))

    return times.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()


def read_requests(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of signed requests to index a repository, lines of JSON."""
    return spark.readStream.schema(REQUESTS).json(folder)


def answered(requests: DataFrame, log: JobLog, master: str, checkpoint: str, clock=time.time, **trigger) -> StreamingQuery:
    """Queues what signed requests ask for and keeps each one's outcome in the log's table ``outcomes``: in one commit, so
    that a batch that is delivered again finds its outcomes and queues nothing."""

    def work(batch: DataFrame, _: int) -> None:
        now = int(clock())
        log.on_app(batch, master, F.timestamp_seconds(F.lit(now)), now)

    return requests.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).start()
