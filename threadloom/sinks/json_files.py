"""JSON exports of dump lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.scalars import WHITESPACE
from threadloom.sources.ndjson import parse_records
from threadloom.sources.numbering import first_lines

# Fixed value: records per exported file.
BATCH_RECORDS = 10_000


def export_sound_lines(lines: DataFrame, path: str) -> None:
    """Lines that hold a record as NDJSON, in as many files as tasks read them."""
    parsed = parse_records(lines, ["id"])
    parsed.filter(F.col("fault").isNull()).select("value").write.mode("overwrite").text(path)


def export_first_lines(lines: DataFrame, path: str, count: int) -> None:
    """The first ``count`` lines of each file as NDJSON; invalid ones are left out but count.

    For the first lines over all files of a dump, take them from a ``LineIndex``, which does not read on.
    """
    export_sound_lines(first_lines(lines, count), path)


def export_batches(lines: DataFrame, path: str, records_per_file: int = BATCH_RECORDS) -> None:
    """All lines, trimmed, in JSON files of at most ``records_per_file`` records."""
    trimmed = lines.select(F.trim("value", F.lit(WHITESPACE)).alias("line"))
    trimmed.write.mode("overwrite").option("maxRecordsPerFile", records_per_file).json(path)
