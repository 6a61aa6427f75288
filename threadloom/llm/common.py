"""Helpers shared by the operators: reading a table, row batches, partition counts, digests."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import io
import os
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from threadloom.session import scratch_path

# Input bytes that one task of a shuffle should get.
TASK_BYTES = 32 * 1024**2
MAX_PARTITIONS = 20_000

# Rows handled at a time in a Python worker.
BATCH_ROWS = 500

# Bytes of text handled at a time; a longer text is a slice of its own.
SLICE_BYTES = 2 * 1024**2

_SENT_TO: set[str] = set()

# What a Python worker keeps between tasks: the operator it belongs to, and its values by name.
_HELD: dict[str, dict] = {}


def give_back() -> None:
    """Give a worker's free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def drop_held(operator: str | None = None) -> None:
    """Drop what a worker keeps, unless it belongs to ``operator``, and give the memory back to the system."""
    if _HELD and operator not in _HELD:
        _HELD.clear()
        give_back()


def held(operator: str, name: object, build: Callable[[], object]) -> object:
    """A worker's own value of an operator, built at first use. Workers serve one operator after the other, so what other
    operators left behind is dropped."""
    drop_held(operator)
    values = _HELD.setdefault(operator, {})
    if name not in values:
        values[name] = build()
    return values[name]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def partition_count(df: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """Shuffle partitions that suit the size the optimizer expects of ``df``, the session's number at least; that number
    where nothing is known of the size, as of rows that come from the driver."""
    expected = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if expected >= 1 << 60:
        return least
    return max(least, min(MAX_PARTITIONS, expected // task_bytes + 1))


def send_package(spark: SparkSession) -> None:
    """Give the executors this package, once for each Spark application, through the shared folder.

    Workers import the operators' modules, and keep what they have read or learned there between tasks.
    """
    context = spark.sparkContext
    if context.applicationId in _SENT_TO:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(top)))
    target = context._jvm.org.apache.hadoop.fs.Path(f"{scratch_path(spark, 'package')}/threadloom.zip")
    out = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target)
    out.write(packed.getvalue())
    out.close()
    context.addPyFile(target.toString())
    _SENT_TO.add(context.applicationId)


def map_arrow(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` with this package on the executors."""
    send_package(df.sparkSession)
    return df.mapInArrow(rows, schema)


def small_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(start, BATCH_ROWS)


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold at most ``most`` bytes of a text column, or one row that holds more."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start] - sizes[start]
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def map_batches(
    df: DataFrame, schema: StructType | str, rows: Callable[[pa.RecordBatch], pa.RecordBatch]
) -> DataFrame:
    """``df`` with every Arrow batch replaced by what ``rows`` makes of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield rows(batch)

    return map_arrow(df, run, schema)


def list_array(values: np.ndarray, lengths: list[int] | np.ndarray) -> pa.ListArray:
    """Arrow lists of the given lengths over one flat array."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def with_columns(batch: pa.RecordBatch, **more: pa.Array) -> pa.RecordBatch:
    """``batch`` with further columns; one of the same name is replaced in its place."""
    names, arrays = list(batch.schema.names), list(batch.columns)
    for name, array in more.items():
        if name in names:
            arrays[names.index(name)] = array
        else:
            names.append(name)
            arrays.append(array)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def schema_with(df: DataFrame, **more: str) -> StructType:
    """Schema of ``df`` with columns added or their types replaced, matching ``with_columns``."""
    added = {name: StructType.fromDDL(f"`{name}` {kind}")[0] for name, kind in more.items()}
    kept = [added.pop(f.name, f) for f in df.schema.fields]
    return StructType([*kept, *added.values()])


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a lost executor costs no recomputation of what came before."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, group) of all nodes in ``edges`` (a, b): the least node that a node is connected with.

    Two steps take turns until nothing changes. In the first every node hands its larger neighbours to its least one, in
    the second its smaller ones and itself; the number of rounds is logarithmic. Minima are formed before the shuffle, so a
    node with very many neighbours costs one row for each task, and the joins are left to adaptive skew handling.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = written(small.select("e.a", "e.b").filter("a <> b").distinct(), "edges")
        after = state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("group")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("group")).union(roots)
