"""Tables read by name or by SQL."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def register_views(tables: Mapping[str, DataFrame]) -> None:
    """Make tables visible to SQL under their names in the session that owns them."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def read_sql(spark: SparkSession, query: str, **tables: DataFrame) -> DataFrame:
    """Result of a SQL query; ``{name}`` in the text stands for a DataFrame passed by that name."""
    return spark.sql(query, **tables)


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())
