"""Line numbers over split files: absolute numbers, first N lines, one line by number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import bounded_broadcast

SPLIT = ["file_path", "block_start"]


def split_offsets(lines: DataFrame, across_files: bool = False) -> DataFrame:
    """One row per file split: lines in it, lines before it, first row id.

    Lines before a split are counted in its own file, or over all files in path order for a dump cut
    into several files. Only counts leave the scan (no text). The running sum is over splits, one row
    per file block, so 100 TB are under a million rows.
    """
    window = Window.orderBy("file_path", "block_start") if across_files else Window.partitionBy("file_path").orderBy("block_start")
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    return (
        lines.groupBy(*SPLIT)
        .agg(F.count("*").alias("split_lines"), F.min("row_id").alias("first_id"))
        .withColumn("lines_before", F.coalesce(F.sum("split_lines").over(before), F.lit(0)))
    )


def _numbered(lines: DataFrame, offsets: DataFrame) -> DataFrame:
    # A split is at most one file block long, so this join has no hot key even without a broadcast.
    # Row ids carry the task number in their upper bits: a scan planned differently from the counting
    # scan is refused instead of numbered wrongly.
    same_task = F.shiftright("row_id", 33) == F.shiftright("first_id", 33)
    number = F.when(same_task, F.col("lines_before") + F.col("row_id") - F.col("first_id") + 1).otherwise(
        F.raise_error(F.lit("file splits changed between two scans; keep the file scan settings fixed"))
    )
    joined = lines.join(bounded_broadcast(offsets), SPLIT, "inner")
    return joined.withColumn("line_no", number).drop("split_lines", "first_id", "lines_before")


def number_lines(lines: DataFrame, across_files: bool = False) -> DataFrame:
    """Add ``line_no``, counted from 1 inside each file or over all files."""
    return _numbered(lines, split_offsets(lines, across_files))


def first_lines(lines: DataFrame, count: int, across_files: bool = False) -> DataFrame:
    """The first ``count`` lines of each file (or of all files), bad and blank lines included in the count."""
    offsets = split_offsets(lines, across_files).filter(F.col("lines_before") < count)
    return _numbered(lines, offsets).filter(F.col("line_no") <= count)


def line_at(lines: DataFrame, number: int, across_files: bool = False) -> DataFrame:
    """Line ``number`` of each file (or of all files); no row where there are fewer lines."""
    holds = (F.col("lines_before") < number) & (F.col("lines_before") + F.col("split_lines") >= number)
    return _numbered(lines, split_offsets(lines, across_files).filter(holds)).filter(F.col("line_no") == number)
