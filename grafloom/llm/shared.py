"""Shared-folder staging, row-number-free helpers and bounded count sketches.

Everything that has to outlive a stage is written below the folder named by ``spark.checkpoint.dir``,
so a lost executor costs a re-read and never the data.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import pickle
import re
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Counters of a sketch and the slices in which they travel; 2**18 counters are 2 MB whatever the input.
SKETCH_CELLS = 1 << 18
SKETCH_SLICES = 32


def shared_root(spark: SparkSession) -> str:
    """The session's checkpoint folder. A local session without one gets a temporary folder; a cluster must name one,
    as its machines don't see each other's temporary folders."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="grafloom-")
        atexit.register(shutil.rmtree, named.removeprefix("file://"), ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/grafloom/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage without keeping blocks on executors."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Deletes the folder behind a ``staged`` frame that no later plan reads."""
    spark = df.sparkSession
    jvm = spark._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sketch_rows(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    width = len(counts) // SKETCH_SLICES
    for i in range(SKETCH_SLICES):
        part = counts[i * width : (i + 1) * width]
        if part.any():
            yield i, part.astype("<i8").tobytes()


def add_sketches(rows: DataFrame, cells: int = SKETCH_CELLS) -> np.ndarray:
    """Sum of partial sketches (slice int, cells binary): each slice is added up in its own task, and at
    most ``SKETCH_SLICES`` rows of fixed length reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(cell.as_buffer(), "<i8")
                sums[i] = sums[i] + part if i in sums else part.copy()
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["slice", "cells"])

    total = np.zeros(cells, np.int64)
    width = cells // SKETCH_SLICES
    summed = rows.select("slice", "cells").repartition(SKETCH_SLICES, "slice").mapInArrow(add, "slice int, cells binary")
    for row in summed.toLocalIterator():
        total[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["cells"], "<i8")
    return total


def with_columns(fields: list[tuple[str, pa.DataType]]) -> Callable[..., pa.RecordBatch]:
    """A maker of record batches in a fixed schema; columns that aren't given are null."""
    schema = pa.schema(fields)

    def make(n: int, /, **cols) -> pa.RecordBatch:
        arrays = []
        for name, kind in fields:
            x = cols.get(name)
            arrays.append(pa.nulls(n, kind) if x is None else x if isinstance(x, pa.Array) else pa.array(x, kind))
        return pa.record_batch(arrays, schema=schema)

    return make


#: Text that travels to a Python worker at once. The engine's own limit counts rows, and rows are of any length.
ARROW_BYTES = 2 << 20
_ARROW_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limit on bytes in an Arrow batch to ARROW_BYTES, unless it is lower."""
    now = spark.conf.get(_ARROW_SETTING, None)
    told = re.fullmatch(r"(\d+)([bkmg]?)b?", (now or "").lower())
    size = int(told[1]) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[told[2]] if told else 0
    if not 0 < size <= ARROW_BYTES:
        spark.conf.set(_ARROW_SETTING, f"{ARROW_BYTES}b")


def _tidy() -> None:
    """Gives back what this worker holds unused; Spark keeps idle workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable, tokens: bool = False, drop: bool = False) -> Callable:
    """``run`` for mapInArrow in a worker that keeps little: without ``tokens`` an encoder that an earlier job left in the
    worker is dropped first, with ``drop`` that of this one at the end, and freed memory is returned when the task
    ends. Spark hands tasks to its idle workers in turn, so an encoder that is kept is kept by each of them."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        held = sys.modules.get(f"{__package__}.tokens")
        if held and not tokens:
            held.encoder.cache_clear()
        try:
            yield from run(batches)
        finally:
            if drop and held:
                held.encoder.cache_clear()
            _tidy()

    return wrapped


def give_back(spark: SparkSession) -> None:
    """Has the executors collect garbage, after which their JVMs return the heap that an earlier step filled and left: a
    later step with large Python workers then finds the room. A task for each core, so that every executor is met; on a
    local master, where driver and executor are one, nothing."""
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        return
    tasks = spark.sparkContext.defaultParallelism
    collected = spark.range(tasks, numPartitions=tasks).select(F.expr("reflect('java.lang.System', 'gc')").alias("x"))
    collected.write.format("noop").mode("overwrite").save()


def in_task(spark: SparkSession, work: Callable, *args):
    """Runs ``work(*args)``, whose input and output are of bounded size, in one Spark task instead of the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield pa.record_batch([pa.array([pickle.dumps(work(*args))], pa.binary())], ["out"])

    return pickle.loads(spark.range(1, numPartitions=1).mapInArrow(lean(run, tokens=True), "out binary").first()["out"])


def fit_in_task(sample: DataFrame, work: Callable[[pa.Table], object]):
    """Hands a sample of bounded size to ``work`` in one Spark task and returns what it makes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        table = pa.Table.from_batches(held) if held else None
        yield pa.record_batch([pa.array([pickle.dumps(work(table))], pa.binary())], ["out"])

    return pickle.loads(sample.repartition(1).mapInArrow(lean(run), "out binary").first()["out"])


#: Most bits of an id filter: 32 MB whatever the input; a fuller filter only lets more rows pass.
FILTER_BITS = 1 << 28
_FILTER_SLICES = 32


def in_bits(ids: pa.Array, bits: np.ndarray) -> np.ndarray:
    """Which ids an ``id_filter`` holds; false for null."""
    at = _filter_places(ids.fill_null(0).to_numpy(zero_copy_only=False), 8 * len(bits))
    return ids.is_valid().to_numpy(zero_copy_only=False) & (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _filter_places(ids: np.ndarray, size: int) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(65 - size.bit_length())).astype(np.int64)


def id_filter(ids: DataFrame, count: int) -> np.ndarray:
    """A bit set that holds every id of a one-column frame of ``count`` rows (and, by collision, some others): 16
    bits a row, up to FILTER_BITS."""
    size = min(FILTER_BITS, max(1 << 13, 1 << (16 * count).bit_length()))
    width = size // _FILTER_SLICES // 8

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            at = _filter_places(batch.column(0).drop_null().to_numpy(), size)
            np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        packed = bits.reshape(_FILTER_SLICES, width)
        for r in np.flatnonzero(packed.any(1)):
            yield pa.record_batch([pa.array([r], pa.int32()), pa.array([packed[r].tobytes()], pa.binary())], ["slice", "cells"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(cell.as_buffer(), np.uint8)
                whole[i] = whole[i] | part if i in whole else part.copy()
        for i, bits in whole.items():
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["slice", "cells"])

    out = np.zeros((_FILTER_SLICES, width), np.uint8)
    rows = ids.mapInArrow(lean(mark), "slice int, cells binary").repartition(_FILTER_SLICES, "slice").mapInArrow(lean(join), "slice int, cells binary")
    for row in rows.toLocalIterator():
        out[row["slice"]] = np.frombuffer(row["cells"], np.uint8)
    return out.reshape(-1)


def in_filter(bits: np.ndarray):
    """A function of an id column: whether the filter holds it; false for null."""

    @F.arrow_udf("boolean")
    def run(ids: pa.Array) -> pa.Array:
        return pa.array(in_bits(ids, bits))

    return run


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` hasn't, however it is cased."""
    return f"{name}_{uuid.uuid4().hex}"
