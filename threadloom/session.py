"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Row bound under which a derived table may be broadcast.
BROADCAST_ROWS = 1_000_000

# Bytes of a table's values under which it may be broadcast.
BROADCAST_BYTES = 64 * 1024**2

# Settings that can also be given to a running session. The method limit is the size up to which the JVM
# compiles a method: a projection over a wide record beyond it would run interpreted, while below
# whole-stage generation Spark splits such a projection into small methods.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

SETTINGS = {
    **RUNTIME_SETTINGS,
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Shuffles start with many partitions, which adaptive execution merges to what their data needs: it can
    # merge partitions but not add any.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "4000",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app_name: str = "threadloom", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the settings the package relies on; ``extra`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Give the runtime settings to a session made elsewhere."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a local one is made only if none is set.

    A machine-local folder would be lost with its machine, so it is refused outside local mode.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if not root and current is not None:
        # Spark keeps checkpoints in a folder of its own below the one it was given.
        root = current.rsplit("/", 1)[0]
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="threadloom-")
    if current is None:
        context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a path made by ``scratch_path``; anything outside the shared folder is left alone."""
    if path.startswith(checkpoint_root(spark).rstrip("/") + "/"):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def counted_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, int]:
    """``df`` written once to the shared folder, marked for broadcast only if its rows and bytes allow it, and its row count.

    Beyond the bounds the table is returned without a hint and the join shuffles on its keys.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "small")
    df.write.parquet(path)
    df = spark.read.schema(df.schema).parquet(path)
    text = [F.octet_length(F.col(f"`{c}`")) if kind in ("string", "binary") else F.lit(8) for c, kind in df.dtypes]
    width = sum((F.coalesce(t.cast("long"), F.lit(0)) for t in text), F.lit(0))
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return (F.broadcast(df) if rows <= max_rows and size <= max_bytes else df), rows


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Materialise a small derived table and mark it for broadcast only if its size allows it."""
    return counted_broadcast(df, max_rows)[0]
