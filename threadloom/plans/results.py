"""Analysis of recorded query runs and load times.

A run is a row ``(system, query, time, memory, output_length)``. Systems are a known short list, so
pivots name their columns instead of collecting them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.scalars import kilobytes_to_megabytes, last_segment, name_category

RUN_SCHEMA = "system string, query string, time double, memory double, output_length bigint"

METRIC_FILE = "struct<times: array<double>, memories: array<double>, output_lengths: array<bigint>>"


def read_metric_file(spark: SparkSession, path: str, system: str) -> DataFrame:
    """Runs out of a file that maps query names to arrays of times, memories and output lengths."""
    whole = spark.read.text(path, wholetext=True)
    series = whole.select(F.explode(F.from_json("value", f"map<string, {METRIC_FILE}>")).alias("query", "m"))
    zipped = F.arrays_zip("m.times", "m.memories", "m.output_lengths")
    return series.select("query", F.explode(zipped).alias("r")).select(
        F.lit(system).alias("system"),
        "query",
        F.col("r.times").alias("time"),
        F.col("r.memories").alias("memory"),
        F.col("r.output_lengths").alias("output_length"),
    )


def recordable(runs: DataFrame) -> DataFrame:
    """Runs worth keeping: an empty result cannot be right. Measures are rounded to 4 places."""
    return runs.filter(F.col("output_length") != 0).withColumns(
        {"time": F.round("time", 4), "memory": F.round("memory", 4)}
    )


def append_runs(runs: DataFrame, path: str) -> None:
    recordable(runs).write.mode("append").parquet(path)


def _measure(measure: str) -> Column:
    return kilobytes_to_megabytes(F.col(measure)) if measure == "memory" else F.col(measure)


def query_means(runs: DataFrame, systems: Sequence[str], measure: str = "time") -> DataFrame:
    """Mean per query, one column per system; memory in MB."""
    return (
        runs.withColumn("_m", _measure(measure)).groupBy("query").pivot("system", list(systems)).agg(F.avg("_m"))
    )


def _query_system_means(runs: DataFrame, measure: str) -> DataFrame:
    return runs.groupBy("query", "system").agg(F.avg(_measure(measure)).alias("mean"))


def category_means(runs: DataFrame, systems: Sequence[str], measure: str = "time") -> DataFrame:
    """Mean of query means per query class, one column per system."""
    means = _query_system_means(runs, measure).withColumn("category", name_category(F.col("query")))
    return means.groupBy("category").pivot("system", list(systems)).agg(F.avg("mean"))


def _upper_bound(system: str, systems: Sequence[str]) -> Column:
    others = [F.col(s) for s in systems if s != system]
    return others[0] if len(others) == 1 else F.greatest(*others)


def bounded_query_means(runs: DataFrame, systems: Sequence[str], measure: str = "time") -> DataFrame:
    """Query means where a system without runs gets the largest mean of the others, flagged ``_too_slow``."""
    means = query_means(runs, systems, measure)
    filled = {s: F.when(F.coalesce(F.col(s), F.lit(0)) > 0, F.col(s)).otherwise(_upper_bound(s, systems)) for s in systems}
    flags = {f"{s}_too_slow": F.coalesce(F.col(s), F.lit(0)) <= 0 for s in systems}
    return means.select(
        "query", *[c.alias(n) for n, c in filled.items()], *[c.alias(n) for n, c in flags.items()]
    )


def bounded_category_means(runs: DataFrame, systems: Sequence[str], measure: str = "time") -> DataFrame:
    """Category means; a system that lacks any query of a category gets the largest mean of the others."""
    means = _query_system_means(runs, measure).withColumn("category", name_category(F.col("query")))
    wanted = means.groupBy("category").agg(F.countDistinct("query").alias("queries"))
    pivoted = (
        means.groupBy("category")
        .pivot("system", list(systems))
        .agg(F.avg("mean").alias("mean"), F.count("mean").alias("runs"))
    )
    complete = {s: F.coalesce(F.col(f"{s}_runs"), F.lit(0)) == F.col("queries") for s in systems}
    known = pivoted.join(wanted, "category").select(
        "category", *[F.when(complete[s], F.col(f"{s}_mean")).alias(s) for s in systems]
    )
    filled = [F.coalesce(F.col(s), _upper_bound(s, systems)).alias(s) for s in systems]
    flags = [F.col(s).isNull().alias(f"{s}_too_slow") for s in systems]
    return known.select("category", *filled, *flags)


def varying_lengths(runs: DataFrame) -> DataFrame:
    """(query, system) pairs whose runs returned different row counts."""
    return (
        runs.groupBy("query", "system")
        .agg(
            F.min("output_length").alias("min_length"),
            F.max("output_length").alias("max_length"),
        )
        .filter(F.col("min_length") != F.col("max_length"))
    )


def unequal_lengths(runs: DataFrame) -> DataFrame:
    """Queries where some row count was not seen in every system that ran the query.

    Distinct counts are grouped as rows; no set of lengths is gathered.
    """
    seen = runs.select("query", "system", "output_length").distinct()
    systems = runs.select("query", "system").distinct().groupBy("query").agg(F.count("*").alias("systems"))
    per_length = seen.groupBy("query", "output_length").agg(F.count("*").alias("seen_in"))
    return (
        per_length.join(systems, "query")
        .groupBy("query", "systems")
        .agg(F.count_if(F.col("seen_in") < F.col("systems")).alias("unshared_lengths"))
        .filter(F.col("unshared_lengths") > 0)
    )


def import_times(loads: DataFrame, files: Sequence[str]) -> DataFrame:
    """Load seconds per system, one column per file name, with ``total`` (-1 where nothing was loaded)."""
    named = loads.withColumn("file_name", last_segment(F.col("data_file")))
    table = named.groupBy("system").pivot("file_name", list(files)).agg(F.sum("time_elapsed_seconds"))
    total = sum((F.coalesce(F.col(f"`{f}`"), F.lit(0)) for f in files), F.lit(0))
    return table.withColumn("total", F.when(total == 0, F.lit(-1)).otherwise(total).cast("bigint"))


def import_times_by_size(loads: DataFrame, systems: Sequence[str], large_lines: int) -> DataFrame:
    """Mean load seconds of large files (at least ``large_lines`` lines) and small ones, per system."""
    size = F.when(F.col("line_count") >= large_lines, F.lit("large")).otherwise(F.lit("small"))
    return (
        loads.withColumn("category", size)
        .groupBy("category")
        .pivot("system", list(systems))
        .agg(F.avg("time_elapsed_seconds"))
    )


def planned_runs(queries: DataFrame, systems: DataFrame) -> DataFrame:
    """Number of (query, system) runs: a product of two counts, no pairs are built."""
    n = queries.select("query").distinct().agg(F.count("*").alias("queries"))
    m = systems.select("system").distinct().agg(F.count("*"))
    return n.select((F.col("queries") * m.scalar()).alias("planned"))
