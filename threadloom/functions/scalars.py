"""Column functions shared by the cleaners, the profiler and the reports. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: length that wiki text can be cut to.
WIKI_CONTENT_LENGTH = 500
# Fixed value: community name inside a wiki path.
WIKI_PATH_PATTERN = "/r/([^/]+)"
# Fixed value: display format of load times.
SUMMARY_TIME_FORMAT = "dd MMMM yyyy HH:mm.ss"

WHITESPACE = " \t\n\r\f\v"


_TRUTH = "CASE lower({c}) WHEN 'true' THEN 1 WHEN 'false' THEN 0 END"

# A raw JSON value, read as text, in its declared column type; NULL where the type cannot hold it.
COERCIONS = {
    "boolean": "coalesce(try_cast({c} AS boolean), try_cast({c} AS double) <> 0)",
    # A number with a fraction is no whole number: it is reported, not cut.
    "bigint": (
        "coalesce(CASE WHEN try_cast({c} AS double) = floor(try_cast({c} AS double)) "
        f"THEN coalesce(try_cast({{c}} AS bigint), try_cast(try_cast({{c}} AS double) AS bigint)) END, {_TRUTH})"
    ),
    "double": f"coalesce(try_cast({{c}} AS double), {_TRUTH})",
    "string": "replace({c}, chr(0), '')",
}


def coercion_sql(name: str, type_name: str) -> str:
    """SQL text of a typed column. Wide projections are built from text: one call per column."""
    return COERCIONS[type_name].format(c=f"`{name}`")


def to_flag(text: Column) -> Column:
    """Boolean from ``true``/``false`` or from a number (zero once cut to an integer is false)."""
    truth = F.when(F.lower(text) == "true", F.lit(1)).when(F.lower(text) == "false", F.lit(0)).cast("bigint")
    return F.coalesce(truth, text.try_cast("double").try_cast("bigint")) != 0


def strip_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\0"), F.lit(""))


def normal_name(text: Column) -> Column:
    """Name form used for matching: surrounding whitespace removed, lower case."""
    return F.lower(F.trim(text, F.lit(WHITESPACE)))


def epoch_seconds(iso_text: Column) -> Column:
    """ISO-8601 time to whole epoch seconds, NULL when it cannot be read."""
    return F.unix_seconds(F.try_to_timestamp(iso_text))


def wiki_community(path: Column, pattern: str = WIKI_PATH_PATTERN) -> Column:
    """Captured community name, ``''`` when the path holds none."""
    return F.regexp_extract(path, pattern, 1)


def cut(text: Column, length: int | None = WIKI_CONTENT_LENGTH) -> Column:
    """The first ``length`` characters, or the whole text."""
    return text if length is None else F.substring(text, 1, length)


def text_or_none(value: Column) -> Column:
    """Text of a value with ``None`` for NULL, as used in computed keys and length counts."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def rule_key(community: Column, priority: Column, short_name: Column, description: Column) -> Column:
    parts = [text_or_none(c) for c in (community, priority, short_name, description)]
    return F.md5(F.concat_ws("_", *parts))


def nested_text(value: Column) -> Column:
    """JSON text of an array, map or struct; an empty array becomes NULL."""
    return F.to_json(value)


def nested_array_text(value: Column) -> Column:
    return F.when(F.size(value) > 0, F.to_json(value))


def name_category(name: Column, separator: str = "_") -> Column:
    return F.split_part(name, F.lit(separator), F.lit(1))


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def kilobytes_to_megabytes(value: Column) -> Column:
    return value / F.lit(1024)


def bytes_to_gigabytes(value: Column) -> Column:
    return value.cast("double") / F.lit(1024.0**3)


def readable_size(size: Column) -> Column:
    """``12.50 KB`` style text; the last unit has no upper end."""
    value = size.cast("double")
    out, units = None, ("bytes", "KB", "MB", "GB", "TB", "PB", "EB")
    for power, unit in enumerate(units):
        # Ties go to the even digit.
        text = F.format_string(f"%.2f {unit}", F.bround(value / F.lit(1024.0**power), 2))
        condition = value.isNotNull() if unit == units[-1] else value < F.lit(1024.0 ** (power + 1))
        out = F.when(condition, text) if out is None else out.when(condition, text)
    return out


def elapsed_seconds(start: Column, end: Column) -> Column:
    return F.unix_seconds(end) - F.unix_seconds(start)


def display_time(moment: Column) -> Column:
    return F.date_format(moment, SUMMARY_TIME_FORMAT)


def record_keys(json_text: Column) -> Column:
    return F.json_object_keys(json_text)


def record_key_count(json_text: Column) -> Column:
    return F.size(F.json_object_keys(json_text))


def array_size(value: Column) -> Column:
    return F.coalesce(F.size(value), F.lit(0))


def array_field(value: Column, name: str) -> Column:
    return F.transform(value, lambda item: item[name])
