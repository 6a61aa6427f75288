"""Keyed operators: first-seen rows, uniqueness checks, differences of name sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import bounded_broadcast


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order.

    Row number one is limited per key before the shuffle as well as after it: each map task sends one
    row per key, so a key that holds a large share of the rows costs one row per task. This measured
    faster than ``min_by`` over a struct, which sorts in both steps too.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(window)).filter(F.col("_nth") == 1).drop("_nth")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count in ``copies``."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def later_copies(df: DataFrame, keys: Sequence[str], place: Sequence[str], repeated: DataFrame | None = None) -> DataFrame:
    """Places of the rows that repeat the key of an earlier row; ``repeated`` has the keys that do, if they are known.

    ``place`` must identify a row and give the order. Only key and place columns are shuffled, and
    only for keys that occur more than once. The anti join is on ``place``, which is unique, so the
    copies of one key spread over all tasks.
    """
    narrow = df.select(*keys, *place)
    if repeated is None:
        repeated = bounded_broadcast(duplicate_keys(narrow, keys).select(*keys))
    suspects = narrow.join(repeated, list(keys), "left_semi")
    kept = first_seen(suspects, keys, place).select(*place)
    return suspects.select(*place).join(kept, list(place), "left_anti")


def marked_rows(places: DataFrame, place: Sequence[str]) -> DataFrame:
    """``places`` as bitmaps: a bit for each value of the last column of ``place``, a whole number, and a row for each 32 768 of them. That
    is exact, and for rows numbered without large gaps a small part of what the places themselves take."""
    *scope, number = place
    at = F.col(number).cast("bigint")
    placed = places.select(*scope, F.bitmap_bucket_number(at).alias("_bucket"), F.bitmap_bit_position(at).alias("_bit"))
    return placed.groupBy(*scope, "_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def with_mark(df: DataFrame, marked: DataFrame, place: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``name``: whether the row's place is in ``marked``, made by ``marked_rows``."""
    *scope, number = place
    at = F.col(number).cast("bigint")
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    met = df.withColumn("_bucket", F.bitmap_bucket_number(at)).join(marked, [*scope, "_bucket"], "left")
    mark = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    return met.select(*[f"`{c}`" for c in df.columns], mark.alias(name))


def known_keys(df: DataFrame, keys: Sequence[str], stored: DataFrame) -> DataFrame:
    """Distinct keys of ``df`` that are also in ``stored``.

    Only key columns are shuffled, and each task sends a key once.
    """
    return df.select(*keys).distinct().join(stored.select(*keys), list(keys), "left_semi")


def drop_listed(df: DataFrame, value: Column, listed: DataFrame) -> DataFrame:
    """Rows whose value is not in the one-column list. NULL values stay."""
    return df.join(listed.toDF("_listed"), value == F.col("_listed"), "left_anti")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of ``left`` that are not in ``right`` (same columns)."""
    return left.subtract(right)


def sets_differ(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows found on one side only, with ``side``; empty when the sets are equal."""
    only_left = left.subtract(right).withColumn("side", F.lit("left"))
    only_right = right.subtract(left).withColumn("side", F.lit("right"))
    return only_left.unionByName(only_right)


def append_loads(*parts: DataFrame) -> DataFrame:
    """All rows of several loads by column name; a column a load lacks is NULL."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
