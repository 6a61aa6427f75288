"""NDJSON scans: lines with their place in the file, parsed records, raw documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.scalars import WHITESPACE

# Columns that place a line: file, split inside the file, row inside the task that reads the split.
PLACE = ("file_path", "block_start", "row_id")

MALFORMED = "malformed_json"
BLANK = "blank_line"

# Fields looked at before a record's own attributes are counted.
WITNESS_FIELDS = 6

STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def pin_split_planning(spark: SparkSession) -> None:
    """Keep file splits the same between two scans even when executors join or leave.

    Split size follows the core count unless a minimum partition number is set, and line numbers are
    computed in one scan and applied in another.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))


def place_columns() -> list[Column]:
    return [
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_id"),
    ]


def read_lines(spark: SparkSession, paths: str | Sequence[str], recursive: bool = False) -> DataFrame:
    """Lines of the given files or folders with ``file_path``, ``block_start`` and ``row_id``.

    Sorting by the three gives file order at any split size: ``row_id`` follows line order inside a
    split and ``block_start`` orders the splits of a file.
    """
    pin_split_planning(spark)
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    return reader.text([paths] if isinstance(paths, str) else list(paths)).select("value", *place_columns())


def list_files(spark: SparkSession, root: str | Sequence[str], recursive: bool = True) -> DataFrame:
    """``path``, ``length`` and ``modified`` of files. The content column is pruned, so no file is read.

    Spark scans skip files without content, so empty files are not listed.
    """
    paths = [root] if isinstance(root, str) else list(root)
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(paths)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )


def find_plain_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root`` with no dot in their name nor in any folder below ``root``."""
    below = F.regexp_replace(F.col("path"), "^.*?" + _quoted(root.rstrip("/")) + "/", "")
    return list_files(spark, root).filter(~F.contains(below, F.lit(".")))


def _quoted(text: str) -> str:
    return "\\Q" + text.split("://")[-1].lstrip("/") + "\\E"


def read_json_document(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """One JSON object, or one array of objects, per file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def is_blank(value: Column) -> Column:
    return F.trim(value, F.lit(WHITESPACE)) == ""


def count_filled(values: Sequence[Column]) -> Column:
    """How many values are neither NULL nor empty."""
    total = F.lit(0)
    for value in values:
        total = total + F.when(value != "", 1).otherwise(0)
    return total


def parse_records(lines: DataFrame, fields: Sequence[str], key_width: int = 1) -> DataFrame:
    """Add ``fault``, ``filled`` and one text column per raw field.

    ``fault`` is NULL for a line that holds one JSON object. ``filled`` counts attributes of the record
    that are neither NULL nor empty: exact up to ``key_width``, attributes outside ``fields`` included,
    and some larger number above that.

    Blank lines get their own fault, so that they can be counted without being reported as bad.

    Every field is read as text (nested values as JSON text), so a value of an unexpected type never
    spoils its record; typing happens in the projection. Fields of a faulty line mean nothing. The line is parsed as the only element of
    an array, which rejects trailing text and two objects on one line.
    """
    ddl = ", ".join(f"`{f}` STRING" for f in fields)
    parsed = F.from_json(F.concat(F.lit("["), F.col("value"), F.lit("]")), f"ARRAY<STRUCT<{ddl}>>", STRICT_JSON)
    closed = F.endswith(F.rtrim(F.col("value"), F.lit(WHITESPACE)), F.lit("}"))
    sound = closed & (F.size("_parsed") == 1) & F.get("_parsed", F.lit(0)).isNotNull()
    fault = F.when(~F.coalesce(sound, F.lit(False)), F.when(is_blank(F.col("value")), BLANK).otherwise(MALFORMED))
    # Any key_width + 1 filled fields settle the count for the skip rule, so a few are enough to look
    # at; the rest of the record is counted only when these leave it open.
    record = F.get("_parsed", F.lit(0))
    seen = count_filled([record[f] for f in fields[: key_width + WITNESS_FIELDS]])
    anywhere = F.size(F.map_filter(F.from_json("value", "map<string,string>"), lambda _, v: v != ""))
    filled = F.when(F.col("_seen") > key_width, F.col("_seen")).otherwise(anywhere)
    row = F.struct(fault.alias("fault"), seen.alias("_seen"), record.alias("_record"))
    # Both steps are generators because the optimizer moves no expression through one. As plain
    # columns the parse would be copied into every later condition that names a field.
    parsed_once = lines.select("*", F.explode(F.array(parsed)).alias("_parsed"))
    return parsed_once.select(*lines.columns, F.inline(F.array(row))).select(
        *lines.columns, "fault", filled.alias("filled"), *[F.col("_record")[f].alias(f) for f in fields]
    )


def read_documents(lines: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Raw records kept whole as VARIANT in ``doc``, with key columns pulled out as text.

    A line whose object repeats a key has no VARIANT form; it keeps NULL in ``doc`` and ``fault`` set.
    Blank lines are dropped.
    """
    doc = lines.filter(~is_blank(F.col("value"))).withColumn("doc", F.expr("try_parse_json(value)"))
    keys = [F.expr(f"try_variant_get(doc, '$.{k}', 'string')").alias(k) for k in key]
    fault = F.when(F.col("doc").isNull(), F.lit(MALFORMED)).alias("fault")
    return doc.select(*lines.columns, fault, *keys, "doc")
