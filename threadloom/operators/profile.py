"""Profiles of dump files: line counts, fingerprints, longest values, change detection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.nested import leaf_lengths
from threadloom.sources.byte_ranges import blocks_of, list_every_file, read_blocks
from threadloom.sources.ndjson import list_files, read_lines
from threadloom.sources.numbering import first_lines

# What a file's fingerprint is made of.
FULL = "content"
PARTIAL = "metadata"


def line_counts(spark: SparkSession, paths: str | Sequence[str], recursive: bool = True) -> DataFrame:
    """``path`` and ``line_count`` of every file, 0 for an empty one. Line ends are counted in the bytes; no line becomes a row."""
    files = list_every_file(spark, paths, recursive)
    counts = read_blocks(blocks_of(files)).groupBy("path").agg(F.sum("line_starts").alias("line_count"))
    return files.select("path").join(counts, "path", "left").fillna(0, "line_count")


def content_fingerprints(lines: DataFrame) -> DataFrame:
    """``path``, ``line_count`` and ``hash`` of each file, sensitive to line order.

    With h the hash of a line and i its number, the fingerprint is the pair (sum h, sum h*i). Each
    split adds up h and h*i for its own numbering; shifting a split by the lines before it adds
    before * sum h. One narrow scan, one row per split in the shuffle, the same result at any split size.
    """
    row_mask = F.lit((1 << 33) - 1)
    split = (
        lines.select(
            "file_path",
            "block_start",
            F.pmod(F.xxhash64("value"), F.lit((1 << 31) - 1)).alias("h"),
            F.col("row_id").bitwiseAND(row_mask).alias("i"),
        )
        .groupBy("file_path", "block_start")
        .agg(
            F.count("*").alias("n"),
            F.min("i").alias("i0"),
            # 31-bit hash times 33-bit row number exceeds a BIGINT once summed.
            F.sum(F.col("h").cast("decimal(20,0)")).alias("s0"),
            F.sum((F.col("h") * F.col("i")).cast("decimal(28,0)")).alias("s1"),
        )
    )
    before = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("i0")
    wide = "decimal(38,0)"
    moved = split.withColumn("s1", F.col("s1").cast(wide) + (shift.cast("decimal(15,0)") * F.col("s0").cast("decimal(22,0)")).cast(wide))
    return (
        moved.groupBy(F.col("file_path").alias("path"))
        .agg(F.sum("n").alias("line_count"), F.sum("s0").alias("s0"), F.sum("s1").alias("s1"))
        .select("path", "line_count", F.md5(F.concat_ws("-", "line_count", "s0", "s1")).alias("hash"))
    )


def _metadata_hash() -> Column:
    return F.md5(F.concat_ws("-", "length", F.unix_micros("modified")))


def file_manifest(spark: SparkSession, paths: str | Sequence[str], recursive: bool = True, method: str = FULL) -> DataFrame:
    """``path, line_count, hash, hash_method, length, modified`` of every file, all files read once.

    ``method`` holds for every file: by ``content``, or by ``metadata``, that is size and time. An empty file has no lines and the fingerprint of no lines.
    """
    files = list_files(spark, paths, recursive)
    empty = list_every_file(spark, paths, recursive).filter("length = 0")
    empty = empty.select(
        "path", F.lit(0).cast("bigint").alias("line_count"), (_metadata_hash() if method == PARTIAL else F.md5(F.lit("0-0-0"))).alias("hash"),
        F.lit(method).alias("hash_method"), "length", "modified",
    )
    content = content_fingerprints(read_lines(spark, paths, recursive)).withColumnRenamed("hash", "content_hash")
    return files.join(content, "path").select(
        "path",
        "line_count",
        (_metadata_hash() if method == PARTIAL else F.col("content_hash")).alias("hash"),
        F.lit(method).alias("hash_method"),
        "length",
        "modified",
    ).unionByName(empty)


def update_manifest(
    spark: SparkSession, old: DataFrame, paths: str | Sequence[str], recursive: bool = True
) -> DataFrame:
    """Current manifest, reading only files whose size or time differs from their entry.

    Other entries are reused with their count, and entries of files that are gone are dropped.
    """
    same_file = ["path", "length", "modified"]
    files = list_every_file(spark, paths, recursive)
    kept = old.join(files, same_file, "left_semi")
    # File names only, which the driver holds anyway to plan a scan of these files.
    stale = [r["path"] for r in files.join(old, same_file, "left_anti").select("path").collect()]
    return kept.unionByName(file_manifest(spark, stale, recursive=False)) if stale else kept


def compare_manifests(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path`` with ``status``: new, changed, unchanged or gone."""
    before = old.select("path", F.col("hash").alias("old_hash"))
    after = new.select("path", F.col("hash").alias("new_hash"))
    status = (
        F.when(F.col("old_hash").isNull(), F.lit("new"))
        .when(F.col("new_hash").isNull(), F.lit("gone"))
        .when(F.col("old_hash") == F.col("new_hash"), F.lit("unchanged"))
        .otherwise(F.lit("changed"))
    )
    return before.join(after, "path", "full").select("path", status.alias("status"))


def refresh_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Manifest after a run: unchanged entries kept, changed and new ones taken, gone ones dropped."""
    status = compare_manifests(old, new)
    kept = old.join(status.filter(F.col("status") == "unchanged"), "path", "left_semi")
    taken = new.join(status.filter(F.col("status").isin("new", "changed")), "path", "left_semi")
    return kept.unionByName(taken)


def max_lengths(spark: SparkSession, paths: str | Sequence[str], max_lines: int | None = None) -> DataFrame:
    """Longest value per file and leaf key, over the first ``max_lines`` lines of each file if given."""
    lines = read_lines(spark, paths)
    if max_lines is not None:
        lines = first_lines(lines, max_lines)
    return leaf_lengths(lines.filter(F.trim("value") != "")).withColumnRenamed("file_path", "file")


def column_max_lengths(df: DataFrame) -> DataFrame:
    """Longest printed value per column of a table: one pass, one row per column."""
    text = [F.length(F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in df.columns]
    longest = df.agg(*[F.max(t).alias(c) for t, c in zip(text, df.columns)])
    return longest.unpivot([], list(df.columns), "key", "max_length")


def summed_sizes(listing: DataFrame) -> DataFrame:
    """``name, size_bytes`` from a listing of files (``name, length``)."""
    return listing.groupBy("name").agg(F.coalesce(F.sum("length"), F.lit(0)).alias("size_bytes"))


def storage_sizes(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """``name, size_bytes`` of each stored table, from the file listing alone (no file is opened)."""
    listings = [list_files(spark, path).select(F.lit(name).alias("name"), "length") for name, path in tables.items()]
    return summed_sizes(reduce(DataFrame.unionByName, listings))
