"""Filters of stored keys: which of many new keys may already be stored, without reading the stored ones.

A filter is a table of bitmaps over hash positions, made on the executors and kept beside the rows of a load. A key whose bit is not
set is not stored. A key whose bit is set may be; with the sixteen bits given to each stored key about one new key in sixteen is, and only those
are looked up. Everything is built from Spark's bitmap functions, so no row leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
# Fixed value: bits of one bitmap of Spark's bitmap functions.
BITMAP_BITS = 32_768

FILTER_SCHEMA = "name string, bucket bigint, bits binary"


def key_text(keys: Sequence[str]) -> Column:
    """One text for a key of one or several columns."""
    return F.col(keys[0]).cast("string") if len(keys) == 1 else F.to_json(F.array(*[F.col(k).cast("string") for k in keys]))


def filter_size(keys: int) -> int:
    """Bits of the filter of so many keys: whole bitmaps."""
    return max(1, -(-keys * BITS_PER_KEY // BITMAP_BITS)) * BITMAP_BITS


def _position(key: Column, size: Column) -> Column:
    return F.pmod(F.xxhash64(key), size)


def key_filter(keys: DataFrame, name: str, size: int) -> DataFrame:
    """Filter rows (``name, bucket, bits``) of the texts in column ``key``; partial bitmaps are merged in the shuffle."""
    at = _position(F.col("key"), F.lit(size).cast("bigint"))
    placed = keys.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"))
    return placed.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).select(F.lit(name).alias("name"), "bucket", "bits")


def possible_hits(keys: DataFrame, filters: DataFrame, sizes: Sequence[tuple[str, int]]) -> DataFrame:
    """Distinct ``key`` values that some filter may hold; ``sizes`` has the part and the bits of every filter asked.

    ``filters`` has ``part, bucket, bits``. Keys meet the one bitmap that can hold them, by an equi-join on it.
    """
    asked = F.explode(F.array(*[F.struct(F.lit(part).alias("part"), F.lit(size).cast("bigint").alias("size")) for part, size in sizes]))
    placed = keys.select("key", asked.alias("f")).select("key", "f.part", _position(F.col("key"), F.col("f.size")).alias("at"))
    placed = placed.select("key", "part", F.bitmap_bucket_number("at").alias("bucket"), F.bitmap_bit_position("at").alias("bit"))
    met = placed.join(filters.select("part", "bucket", "bits"), ["part", "bucket"])
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    return met.filter(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1).select("key").distinct()
