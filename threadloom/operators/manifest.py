"""Manifests of dump files by blocks: a file that only grew is read from its old end.

A file's fingerprint is made of the digests of its blocks in order. When a file has become longer, the block its old end lies in is read again: if
the old part of it still has its old digest, the blocks before it are taken over and only what follows is read. (A change in front of
that block, made together with an append, would not be noticed; ``full`` reads everything.) Empty files have an entry too, so a file that was emptied
counts as changed and not as gone.
"""

from __future__ import annotations

from collections.abc import Sequence

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.session import scratch_path
from threadloom.sources.byte_ranges import BLOCK_BYTES, blocks_of, list_every_file, read_blocks

BLOCKS = "blocks"
# Digests of so many blocks are put together before those of a file are.
GROUP = 1024

MANIFEST_COLUMNS = ("path", "length", "modified", "number", "size", "line_starts", "digest", "bytes_read")


def _kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder, so that what it reads is read once, and seen in one state, however often it is used."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _read(blocks: DataFrame) -> DataFrame:
    """What reading the blocks gave, with the size and time of their files."""
    found = read_blocks(blocks).select("path", "number", "size", "line_starts", "digest", "checked", "bytes_read")
    files = blocks.select("path", "length", "modified").distinct()
    return found.join(files, "path")


def _empty_entries(files: DataFrame) -> DataFrame:
    nothing = {"number": 0, "size": 0, "line_starts": 0, "bytes_read": 0}
    out = files.filter("length = 0").select("path", "length", "modified", *[F.lit(v).cast("bigint").alias(n) for n, v in nothing.items()])
    return out.withColumn("digest", F.lit(xxhash.xxh3_128().hexdigest()))


def block_manifest(
    spark: SparkSession, roots: str | Sequence[str], old: DataFrame | None = None, full: bool = False, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row for each block of every file: ``path, length, modified, number, size, line_starts, digest, bytes_read``.

    With ``old``, an earlier manifest in a stored table, files of the same size and time are taken over, longer ones are read from their old end, and others anew;
    files that are gone lose their rows. ``bytes_read`` counts what this call has read.
    """
    files = _kept(list_every_file(spark, roots), "listing")
    if old is None or full:
        return _read(blocks_of(files, block_bytes=block_bytes)).select(*MANIFEST_COLUMNS).unionByName(_empty_entries(files).select(*MANIFEST_COLUMNS))
    old = old.withColumn("bytes_read", F.lit(0).cast("bigint"))
    before = old.groupBy("path").agg(F.first("length").alias("old_length"), F.first("modified").alias("old_modified"))
    files = files.join(before, "path", "left")
    same = (F.col("length") == F.col("old_length")) & (F.col("modified") == F.col("old_modified"))
    state = F.when(same, "same").when((F.col("old_length") > 0) & (F.col("length") > F.col("old_length")), "grown").otherwise("other")
    files = _kept(files.withColumn("state", F.coalesce(state, F.lit("other"))), "file-states")
    taken = old.join(files.filter("state = 'same'").select("path"), "path", "left_semi")
    anew = _read(blocks_of(files.filter("state = 'other'"), block_bytes=block_bytes))

    # The block that holds the last old byte, and how much of it is old.
    grown = files.filter("state = 'grown'").withColumn("turn", F.expr(f"(old_length - 1) div {block_bytes}"))
    tail = blocks_of(grown, "turn", block_bytes).withColumn("check", F.when(F.col("number") == F.col("turn"), F.col("old_length") - F.col("turn") * block_bytes))
    tail = _kept(_read(tail), "grown-ends")
    turns = old.select("path", "number", F.col("digest").alias("old_digest")).join(grown.select("path", F.col("turn").alias("number")), ["path", "number"])
    kept = tail.filter(F.col("checked").isNotNull()).join(turns, ["path", "number"]).filter(F.col("checked") == F.col("old_digest")).select("path")
    head = old.drop("length", "modified").join(grown.select("path", "length", "modified", "turn"), "path").filter(F.col("number") < F.col("turn"))
    head = head.join(kept, "path", "left_semi")
    changed = grown.join(kept, "path", "left_anti")
    again = blocks_of(changed, block_bytes=block_bytes).filter(F.col("number") < F.col("turn"))
    parts = [taken, anew, tail, head, _read(again), _empty_entries(files)]
    out = parts[0].select(*MANIFEST_COLUMNS)
    for part in parts[1:]:
        out = out.unionByName(part.select(*MANIFEST_COLUMNS))
    return out


def file_manifest_of(blocks: DataFrame) -> DataFrame:
    """``path, line_count, hash, hash_method, length, modified, bytes_read`` of every file of a block manifest.

    Digests are put together in two steps, so that no group grows with a file.
    """

    def joined(parts: DataFrame, order: str, *keys: str) -> DataFrame:
        digests = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "digest"))), lambda p: p["digest"]), "")
        sums = [F.sum(c).alias(c) for c in ("line_count", "bytes_read")]
        return parts.groupBy("path", *keys).agg(F.md5(digests).alias("digest"), *sums, F.first("length").alias("length"), F.first("modified").alias("modified"))

    groups = blocks.withColumnRenamed("line_starts", "line_count").withColumn("part", F.floor(F.col("number") / GROUP))
    files = joined(joined(groups, "number", "part"), "part")
    return files.select("path", "line_count", F.col("digest").alias("hash"), F.lit(BLOCKS).alias("hash_method"), "length", "modified", "bytes_read")
