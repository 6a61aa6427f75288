"""Joins of the query suite that are more than one DataFrame call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.skew import MOST_TRACKED, heavy_keys
from threadloom.session import counted_broadcast


def array_lookup(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    value: str,
    row_key: str,
    part_values: int | None = None,
) -> DataFrame:
    """Left rows with ``matches`` (count of right rows), ``part`` and ``values`` (array of right values).

    A left row without a match keeps an empty array. Right rows are first reduced to the keys asked
    for and shuffled once, by key: the arrays and the join use the same partitioning. Without ``part_values`` each left row is one row, however many
    matches it has. With it, a key with more matches comes in several parts of about that size, by a hash of ``row_key``, so no
    row and no task holds a whole hot key, and every match is in exactly one part however often a task is rerun. Such keys are found
    by a sketch, which at four millionths of the rows may leave a key in one part. Keys of ``left`` must be unique.
    """
    wanted = left.select(F.col(left_key).alias("_key"))
    columns = [F.col(right_key).alias("_key"), F.col(row_key).alias("_row"), F.col(value).alias("_value")]
    matching = right.select(*columns).join(wanted, "_key", "left_semi")
    if part_values is None:
        arrays = matching.groupBy("_key").agg(F.collect_list("_value").alias("values"))
        arrays = arrays.select("_key", F.size("values").cast("bigint").alias("matches"), F.lit(0).cast("bigint").alias("part"), "values")
    else:
        arrays = _parted_arrays(right, matching, right_key, part_values)
    return (
        left.join(arrays, left[left_key] == F.col("_key"), "left")
        .drop("_key")
        .withColumns(
            {
                "matches": F.coalesce("matches", F.lit(0)),
                "part": F.coalesce("part", F.lit(0)),
                "values": F.coalesce("values", F.array().cast("array<string>")),
            }
        )
    )


def _parted_arrays(right: DataFrame, matching: DataFrame, right_key: str, part_values: int) -> DataFrame:
    """Arrays of the values of each key, of hot keys in parts. Only rows of hot keys are counted, after a filter by them."""
    rows = right.count()
    share = max(4 / MOST_TRACKED, min(1.0, part_values / max(1, rows)))
    # No more keys than 2 / share can reach half of the share.
    maybe = F.broadcast(heavy_keys(right, right_key, share)) if share >= 1e-5 else heavy_keys(right, right_key, share)
    keys = right.select(F.col(right_key).alias("key"))
    counts = keys.join(maybe, "key", "left_semi").groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("_total"))
    hot, _ = counted_broadcast(counts.filter(F.col("_total") > part_values))
    parts = F.ceil(F.col("_total") / F.lit(part_values))
    part = F.coalesce(F.pmod(F.xxhash64("_row"), parts), F.lit(0).cast("bigint"))
    return (
        matching.join(hot, "_key", "left")
        .groupBy("_key", "_total", part.alias("part"))
        .agg(F.collect_list("_value").alias("values"))
        .withColumn("matches", F.coalesce("_total", F.size("values").cast("bigint")))
        .drop("_total")
    )


def lookup_unwind(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """A row per match; left rows without a match are dropped. Right columns must not clash with left ones."""
    return left.join(right, left[left_key] == right[right_key], "inner")
