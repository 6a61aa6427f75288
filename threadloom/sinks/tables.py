"""Table sinks: append, replace, key layout, documents, creation and removal of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.catalog import DEFAULT_CATALOG, Catalog

# Column that names the load a row came with; a rerun replaces the rows of its own load only.
LOAD = "load_id"


def append_load(df: DataFrame, path: str, load_id: str) -> None:
    """Write one load into its own folder of the table. Running it again replaces that folder.

    A plain append would leave a second copy when a failed load is repeated.
    """
    df.write.mode("overwrite").parquet(f"{path}/{LOAD}={load_id}")


def replace_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.drop(LOAD) if LOAD in df.columns else df


def with_key_layout(df: DataFrame, keys: Sequence[str], spread: Sequence[str] = (), files: int | None = None) -> DataFrame:
    """Sort rows by key over files, so that Parquet statistics let a key lookup skip files.

    ``spread`` adds columns to the range bounds: rows of one hot key then fill several files instead
    of one. For a join key give the table's own key here.
    """
    order = [*keys, *spread]
    ranged = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Catalogue table bucketed and sorted by a unique key, so joins on the key need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)


def write_documents(documents: DataFrame, path: str, keys: Sequence[str], load_id: str) -> None:
    """Raw documents as VARIANT with their key columns, laid out by key."""
    append_load(with_key_layout(documents.select(*keys, "doc"), keys), path, load_id)


def create_tables(spark: SparkSession, catalog: Catalog = DEFAULT_CATALOG, database: str | None = None) -> list[str]:
    """Create the catalogue's tables that do not exist; returns the names created."""
    created = []
    for table in catalog.columns:
        name = f"{database}.{table}" if database else table
        if not spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in catalog.schema(table).fields)
            keys = ",".join(catalog.key(table))
            spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet TBLPROPERTIES ('primary_key' = '{keys}')")
            created.append(name)
    return created


def drop_unfinished(spark: SparkSession, tables: Sequence[str], finished: DataFrame, overwrite: bool) -> list[str]:
    """Drop tables that exist but that no ledger entry names; without ``overwrite`` they are kept.

    ``finished`` has one table name per row. Returns the tables that are still in the way.
    """
    done = finished.toDF("table")
    existing = [t for t in tables if spark.catalog.tableExists(t)]
    candidates = spark.createDataFrame([(t,) for t in existing], "table string")
    # The catalogue's table names, a fixed small set.
    loose = [r["table"] for r in candidates.join(done, "table", "left_anti").collect()]
    if overwrite:
        for table in loose:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        return []
    return sorted(loose)


def quarantine(rows: DataFrame, path: str, load_id: str) -> None:
    """Keep the rejected rows of a load with the reason, the raw line and its place, in one write.

    ``kind`` says what a row was rejected from: a table, or the lines of a source.
    """
    named = rows.withColumn("table", F.regexp_replace("kind", "^lines:", ""))
    named.select("table", "kind", "fault", "value", "file_path", "block_start", "row_id").write.mode("overwrite").parquet(f"{path}/{LOAD}={load_id}")
