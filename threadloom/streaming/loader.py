"""Incremental loads with Structured Streaming: new files of a folder, one fan-out per micro-batch."""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threadloom.catalog import DEFAULT_CATALOG, Catalog
from threadloom.operators.cleaners import CleanerRegistry, default_cleaners
from threadloom.operators.keys import first_seen
from threadloom.plans.load import Store, counted_lines, load_name, load_records, staged_records
from threadloom.sinks import commits as log

# Send the state function to the executors with the plan, so that they need not have the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Arrival order: older files first, then line order.
ARRIVAL = ("modified", "file_path", "block_start", "row_id")


def stream_lines(spark: SparkSession, path: str, files_per_batch: int = 1000, recursive: bool = False) -> DataFrame:
    """Lines of a folder as a stream, oldest files first."""
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch)
        .option("latestFirst", False)
        .option("recursiveFileLookup", str(recursive).lower())
        .text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.col("_metadata.file_modification_time").alias("modified"),
        )
    )


def stream_identity(spark: SparkSession, checkpoint: str) -> str:
    """Identity of the stream that a checkpoint belongs to, which Spark writes there before the first batch."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def stream_source(
    lines: DataFrame,
    source: str,
    store: Store,
    checkpoint: str,
    tables: Sequence[str] | None = None,
    registry: CleanerRegistry | None = None,
    catalog: Catalog = DEFAULT_CATALOG,
    on_duplicate: str = "quarantine",
) -> StreamingQuery:
    """Load everything that has arrived, then stop; run again to load what arrived since.

    The checkpoint remembers the files read. A micro-batch is staged once and published by one commit, which carries the identity that
    Spark keeps in the checkpoint and the batch number: a batch that is run again replaces its own rows, and never
    those of another stream. First-seen authors are taken inside the batch and then checked against the stored
    table: no state grows in memory. The commit is also the summary row of the batch.
    """
    registry = registry or default_cleaners()
    wanted = list(tables or catalog.sources[source].tables)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version = log.last_version(spark, store.commits)
        load_id = f"{load_name('stream', source, stream_identity(spark, checkpoint))}.{batch_id:012d}"
        commit = log.Commit(load_id, "stream", load_id, time.time())
        placed, counted = counted_lines(batch.withColumn("row_id", F.monotonically_increasing_id()))
        with staged_records(placed, source, wanted, catalog) as records:
            commit.line_count = counted.get["lines"]
            load_records(records, source, store, commit, wanted, registry, catalog, ARRIVAL, on_duplicate)
            log.publish(spark, store.commits, commit, version)

    return (
        lines.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def first_arrivals(rows: DataFrame, keys: Sequence[str], order: Sequence[str], time_to_live: str | None = None) -> DataFrame:
    """The stream ``rows`` reduced to the first row of each key in the given order, over all micro-batches, with ``revision``.

    ``order`` must sort as text after ``cast("string")`` with equal widths, or be numbers and times. A row that belongs before the one sent is
    sent with the next revision; ``latest_revisions`` reads what was sent. State is one small row for each key, never the rows. ``time_to_live``,
    such as ``90 days``, forgets idle keys and so bounds the state; a key that comes back later counts as new.
    """
    spark = rows.sparkSession
    millis = None if time_to_live is None else int(spark.sql(f"SELECT INTERVAL {time_to_live} AS i").first()[0].total_seconds() * 1000)
    kinds = dict(rows.dtypes)

    def sortable(name: str) -> Column:
        if kinds[name] == "string":
            return F.col(name)
        number = F.unix_micros(F.col(name)) if kinds[name] == "timestamp" else F.col(name).cast("bigint")
        return F.lpad((number.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")

    # One text for the place, its parts ended by a character below all that occur in paths.
    placed = rows.withColumn("place", F.concat_ws("\x01", *[sortable(c) for c in order]))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", revision bigint"

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = None
        for frame in frames:
            at = frame["place"].idxmin() if len(frame) else None
            if at is not None and (best is None or frame["place"][at] < best["place"].iloc[0]):
                best = frame.loc[[at]]
        place, revision = state.get if state.exists else (None, -1)
        if best is not None and (place is None or best["place"].iloc[0] < place):
            place, revision = best["place"].iloc[0], revision + 1
            yield best.drop(columns="place").assign(revision=revision)
        state.update((place, revision))
        if millis is not None:
            state.setTimeoutDuration(millis)

    timeout = GroupStateTimeout.NoTimeout if millis is None else GroupStateTimeout.ProcessingTimeTimeout
    return placed.groupBy(*keys).applyInPandasWithState(advance, out, "place string, revision bigint", "append", timeout)


def stream_first_arrivals(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], path: str, checkpoint: str, time_to_live: str | None = None
) -> StreamingQuery:
    """Append the first row of each key, and corrections of it, to a Parquet table.

    Without ``time_to_live`` it stops when all that has arrived is read. With it the query runs on until it is stopped, since Spark looks for
    idle keys in further batches for ever.
    """
    writer = first_arrivals(rows, keys, order, time_to_live).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if time_to_live is None else writer.trigger(processingTime="1 minute")).start()


def latest_revisions(sent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of the rows a stream of first arrivals has sent, the last for each key."""
    return first_seen(sent, keys, [F.desc("revision")]).drop("revision")


def stream_any_per_key(lines: DataFrame, keys: Sequence[str], path: str, checkpoint: str) -> StreamingQuery:
    """One row per key, whichever arrives first in the running state, appended to a Parquet table.

    Keys stay in the state store for good; use it where the key set is bounded.
    """
    return (
        lines.dropDuplicates(list(keys))
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
