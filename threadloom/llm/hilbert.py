"""Shards along a Hilbert curve over several metadata columns, with DataFrame functions only.

Each column is quantised to ``2**bits`` steps, the steps are turned into a place on the Hilbert curve, rows are sorted by
it, and the sorted rows are cut into runs of equal row count (law ``rows``: counts differ by one at most). Neighbours on
the curve are neighbours in every column, so a file of a run has narrow ranges in all of them and readers can skip it.

Row numbers come from the sorted partitions: the place in its partition, which Spark's own row id holds, plus the rows of
the partitions before. No window spans the data, and a value that a third of the rows share is split, since the sort
goes on by key and checksum within equal curve places. Only metadata is shuffled, never text.

Defined cases: a null value is the lowest step; null text has size 1 and checksum 0; equal rows stand next to each
other; an empty table gives no rows. ``number_along`` keeps all columns; one called like a column it adds is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import partition_count
from threadloom.session import scratch_path

SHARDS = 8
BITS = 8
ROW_BITS = 33  # of Spark's row id: the place in the partition


def curve_place(steps: list[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of a point whose coordinates are whole numbers of ``bits`` bits.

    From the highest bit down, the reflections and exchanges of axes that the curve has made in the subcube named by that
    bit are undone in the lower bits. What remains is the Gray code of the place, its bits dealt out over the axes.
    """
    n, long = len(steps), lambda v: F.lit(v).cast("long")
    point = F.array(*[s.cast("long") for s in steps])

    def turned(x: Column, mask: Column, axis: int) -> Column:
        low = mask - long(1)
        reflected = [x[0].bitwiseXOR(low), *[x[i] for i in range(1, n)]]
        moved = x[0].bitwiseXOR(x[axis]).bitwiseAND(low)
        exchanged = [x[i].bitwiseXOR(moved) if i in (0, axis) and axis else x[i] for i in range(n)]
        return F.when(x[axis].bitwiseAND(mask) != 0, F.array(*reflected)).otherwise(F.array(*exchanged))

    def turn_at(mask: Column, axis: int):
        return lambda x, _: turned(x, mask, axis)

    def one_bit(x: Column, mask: Column) -> Column:
        for axis in range(n):
            # Through a list of one element, so that each axis's expression stands once and not once for each use.
            x = F.aggregate(F.array(long(axis)), x, turn_at(mask, axis))
        return x

    masks = F.array(*[long(1 << b) for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<bigint>")
    untangled = F.aggregate(masks, point, one_bit)
    # Gray code to number: each axis takes the exclusive or of all axes up to it ...
    summed = F.aggregate(
        untangled,
        F.array().cast("array<bigint>"),
        lambda done, v: F.concat(done, F.array(v.bitwiseXOR(F.coalesce(F.get(done, F.size(done) - 1), long(0))))),
    )
    # ... and every bit takes those of the last axis above it.
    above = lambda x: F.aggregate(
        masks, long(0), lambda t, m: F.when(F.element_at(x, -1).bitwiseAND(m) != 0, t.bitwiseXOR(m - long(1))).otherwise(t)
    )
    numbers = F.aggregate(
        F.array(summed), F.array().cast("array<bigint>"), lambda _, x: F.transform(x, lambda v: v.bitwiseXOR(above(x)))
    )
    bit_places = F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)])
    interleaved = lambda x: F.flatten(
        F.transform(bit_places, lambda b: F.transform(x, lambda v: F.call_function("shiftright", v, b).bitwiseAND(long(1))))
    )
    return F.aggregate(interleaved(numbers), long(0), lambda h, bit: h * 2 + bit)


def size_step(size: Column) -> Column:
    """Step of a size of at least 1, four steps to each doubling, in whole numbers."""
    exponent = F.length(F.bin(size)) - 1
    quarter = F.call_function("shiftright", size * 4, exponent).bitwiseAND(F.lit(3).cast("long"))
    return F.least(F.lit(255), exponent * 4 + quarter)


def text_step(text: Column, low: str | None, high: str | None, bits: int = BITS) -> Column:
    """Step of a string between the least and the greatest one, in their order: the two characters after the beginning
    that all values share, as a number."""
    low, high = low or "", high or ""
    shared = next((i for i in range(min(len(low), len(high))) if low[i] != high[i]), min(len(low), len(high)))

    def number(c: Column) -> Column:
        parts = [F.least(F.lit(255), F.ascii(F.substring(c, shared + 1 + i, 1))) for i in range(2)]
        return parts[0] * 256 + parts[1]

    span = number(F.lit(high)) - number(F.lit(low)) + 1
    return F.coalesce(F.floor((number(text) - number(F.lit(low))) * F.lit(1 << bits) / span), F.lit(0))


def number_along(df: DataFrame, place: Column, ties: list[str]) -> tuple[DataFrame, int]:
    """``df`` with ``rank``, the row number from 0 in the order of ``place`` and then ``ties``, and the number of rows.

    One range shuffle. The sorted rows are written to the shared folder, so that the numbers stay those of one run even if
    executors are lost; what is summed in one task and broadcast is one row count for each partition.
    """
    at, inside = "_partition", "_inside"
    df = df.drop("rank", at, inside, "_place").withColumn("_place", place)
    keys = ["_place", *ties]
    ordered = df.repartitionByRange(partition_count(df), *keys).sortWithinPartitions(*keys)
    ordered = ordered.withColumn(at, F.spark_partition_id()).withColumn(
        inside, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1).cast("long"))
    )
    path = scratch_path(df.sparkSession, "hilbert")
    ordered.write.parquet(path)
    ordered = df.sparkSession.read.schema(ordered.schema).parquet(path)
    before = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    counts = ordered.groupBy(at).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows")).first()[0] or 0
    bases = counts.select(at, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_base"))
    ranked = ordered.join(F.broadcast(bases), at).withColumn("rank", F.col("_base") + F.col(inside))
    return ranked.drop(at, inside, "_base", "_place"), total


def assign_shards(df: DataFrame, place: Column, ties: list[str], shards: int = SHARDS) -> DataFrame:
    """``df`` with ``shard`` and ``slot``: ``shards`` runs of the sorted rows, with counts at most one apart."""
    ranked, total = number_along(df.drop("shard", "slot"), place, ties)
    shard = F.expr(f"CAST(rank * {shards} DIV {max(total, 1)} AS INT)")
    first = F.expr(f"(CAST(shard AS BIGINT) * {total} + {shards - 1}) DIV {shards}")
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("rank") - first).drop("rank")


def document_metadata(documents: DataFrame) -> DataFrame:
    """What sharding needs of a document: size in bytes plus one, checksum, language and source."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return documents.select(
        "doc_id", "lang", "source", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")
    )


def document_place(meta: DataFrame) -> Column:
    """Curve place of ``document_metadata`` rows by source, language and size."""
    ends = meta.agg(*[f(c) for c in ("source", "lang") for f in (F.min, F.max)]).first()
    return curve_place(
        [text_step(F.col("source"), ends[0], ends[1]), text_step(F.col("lang"), ends[2], ends[3]), size_step(F.col("size"))]
    )


def write_shards(documents: DataFrame, target: str, shards: int = SHARDS) -> None:
    """Write ``documents`` to ``target`` in one folder per shard, sorted along the curve within it.

    Here whole rows are shuffled, since they are what is written; each task writes one range of slots.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = documents.withColumn("size", (F.octet_length(raw) + 1).cast("long")).withColumn("text_crc32", F.crc32(raw))
    placed = assign_shards(sized, document_place(document_metadata(documents)), ["doc_id", "text_crc32", "size"], shards)
    rows = placed.select(*documents.columns, "shard", "slot")
    rows = rows.repartitionByRange(partition_count(documents), "shard", "slot").sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").parquet(target)
