"""Joins on a key of which a few values hold a large share of the rows.

A sketch finds these values in one scan of the key column; each task sends a sketch of bounded size. Only their rows are salted, so all other keys
join as they would anyway. Whatever the sketch says, the result is that of the plain join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import counted_broadcast

# Share of the rows from which on a key is salted, and the tasks its rows go to.
HEAVY_SHARE = 1 / 1000
SALTS = 64
# Fixed value: most items the sketch function tracks. It errs by at most four millionths of the rows with them.
MOST_TRACKED = 1_000_000


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> DataFrame:
    """``key`` values that hold about ``share`` of the rows or more, at most ``1 / share`` of them; NULL is none."""
    tracked = int(min(MOST_TRACKED, max(1000, 100 / share)))
    found = df.select(F.col(f"`{key}`").alias("key")).filter("key IS NOT NULL")
    top = found.agg(F.count(F.lit(1)).alias("rows"), F.expr(f"approx_top_k(key, {int(min(tracked, 2 / share) + 1)}, {tracked})").alias("top"))
    items = top.select("rows", F.inline("top")).filter(F.col("item").isNotNull() & (F.col("count") >= F.col("rows") * (share / 2)))
    return items.select(F.col("item").alias("key"))


def salted_join(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner", share: float = HEAVY_SHARE, salts: int = SALTS
) -> DataFrame:
    """``left`` joined with ``right`` (``inner`` or ``left``) where heavy keys of ``left`` are spread over ``salts`` tasks.

    Rows of ``right`` with such a key are repeated once for each salt; keys should be nearly unique there. Columns must not clash.
    """
    if how not in ("inner", "left"):
        raise ValueError("only rows of the left side can be spread")
    # At most 1 / share keys.
    heavy, _ = counted_broadcast(heavy_keys(left, left_key, share).withColumn("_heavy", F.lit(True)))
    spread = left.join(heavy, left[left_key] == heavy["key"], "left").drop("key")
    # The salt follows from the row, so that a task that runs again deals as before.
    salt = F.when(F.col("_heavy"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)).cast("int")).otherwise(0)
    spread = spread.withColumn("_salt", salt).drop("_heavy")
    again = heavy.select(F.col("key").alias("_key"), F.col("_heavy"))
    repeated = right.join(again, right[right_key] == again["_key"], "left").drop("_key")
    number = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = repeated.withColumn("_right_salt", F.explode(number)).drop("_heavy")
    met = spread.join(repeated, (spread[left_key] == repeated[right_key]) & (spread["_salt"] == repeated["_right_salt"]), how)
    return met.drop("_salt", "_right_salt")
