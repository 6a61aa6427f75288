"""Loading: lines of a source to its tables, with ledger, summary and quarantine.

One load is parsed once into a columnar staging copy in the shared folder; the tables, the checks and
the quarantine all read that copy with only the columns they need. Every run of a load writes to folders of its own and is published
by one commit (see ``sinks.commits``): its tables, its ledger entries and its summary appear together, and a load that failed half-way shows nothing
and can simply be run again.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from threadloom.catalog import DEFAULT_CATALOG, Catalog
from threadloom.functions.scalars import display_time
from threadloom.operators.cleaners import (
    CleanerRegistry,
    apply_skip_rule,
    default_cleaners,
    key_fault,
    left_out,
    loses_values,
    lost_values,
    project,
)
from threadloom.operators.key_filter import FILTER_SCHEMA, filter_size, key_filter, key_text, possible_hits
from threadloom.operators.keys import first_seen, marked_rows, with_mark
from threadloom.session import counted_broadcast, drop_scratch, scratch_path, tune
from threadloom.sinks import commits as log
from threadloom.sinks.commits import Commit, Part
from threadloom.sinks.tables import quarantine, with_key_layout
from threadloom.sources.line_index import first_lines_of
from threadloom.sources.ndjson import MALFORMED, PLACE, parse_records, read_documents, read_lines

LEDGER_SCHEMA = "file string, `table` string"
# Mark rows with a value their type cannot hold, on the way to the files, and rows whose key came before.
LOST = "_lost"
COPY = "_copy"
QUARANTINE_SCHEMA = (
    "`table` string, kind string, fault string, value string, file_path string, block_start bigint, row_id bigint"
)


class DuplicateKeyError(RuntimeError):
    pass


@dataclass(frozen=True)
class Store:
    """Folder layout of a loaded archive. Tables and documents are read through the commits, not by their folders."""

    path: str

    def table(self, name: str) -> str:
        return f"{self.path}/tables/{name}"

    def documents(self, collection: str) -> str:
        return f"{self.path}/documents/{collection}"

    @property
    def commits(self) -> str:
        return f"{self.path}/commits"

    @property
    def keys(self) -> str:
        return f"{self.path}/keys"

    @property
    def line_index(self) -> str:
        return f"{self.path}/line_index"

    @property
    def quarantine(self) -> str:
        return f"{self.path}/quarantine"


def read_loaded(
    spark: SparkSession, store: Store, table: str, catalog: Catalog = DEFAULT_CATALOG, version: int | None = None
) -> DataFrame:
    """Rows of a table that loads have published, as of the last commit or of an earlier one."""
    schema = catalog.schema(table)
    found = log.read_published(spark, store.commits, store.table(table), table, schema, version)
    return spark.createDataFrame([], schema) if found is None else found


def read_collection(spark: SparkSession, store: Store, collection: str, version: int | None = None) -> DataFrame | None:
    """Published documents of a collection, or None where there are none."""
    return log.read_published(spark, store.commits, store.documents(collection), f"documents/{collection}", version=version)


def ledger(spark: SparkSession, store: Store) -> DataFrame:
    """``file, table`` of everything loaded to its end."""
    done = log.commits(spark, store.commits).filter("complete")
    return done.select(F.col("data_file").alias("file"), F.explode("parts.name").alias("table")).distinct()


def summary(spark: SparkSession, store: Store) -> DataFrame:
    """One row for each published load, in the columns of a load report."""
    start, end = F.timestamp_seconds("started"), F.timestamp_seconds("ended")
    return log.commits(spark, store.commits).select(
        "system",
        "data_file",
        F.unix_seconds(start).alias("start_time"),
        F.unix_seconds(end).alias("end_time"),
        display_time(start).alias("start_time_formatted"),
        display_time(end).alias("end_time_formatted"),
        (F.unix_seconds(end) - F.unix_seconds(start)).alias("time_elapsed_seconds"),
        F.filter("parts.name", lambda n: ~F.startswith(n, F.lit("documents/"))).alias("tables"),
        "line_count",
        F.size("parts").alias("writes"),
    )


def read_quarantine(spark: SparkSession, store: Store) -> DataFrame:
    """Rows set aside by published loads, and by the last run of loads that have never been published.

    A run that failed keeps its rows until the load has been published; what earlier tables of a load left stays when later ones are loaded.
    """
    rows = spark.read.schema(f"{QUARANTINE_SCHEMA}, load_id string").parquet(store.quarantine)
    done = log.commits(spark, store.commits).select(F.concat_ws("-", "load_id", "run").alias("load_id"), F.col("load_id").alias("_load"))
    return rows.join(done.select("load_id"), "load_id", "left_semi").unionByName(
        rows.withColumn("_load", F.regexp_replace("load_id", "-[^-]*$", "")).join(done.select("_load").distinct(), "_load", "left_anti").drop("_load")
    )


def sweep(spark: SparkSession, store: Store, catalog: Catalog = DEFAULT_CATALOG, min_age_seconds: float = 24 * 3600) -> list[str]:
    """Remove the folders of failed and replaced runs."""
    roots = [store.table(t) for t in catalog.columns] + [store.documents(s.collection) for s in catalog.sources.values()] + [store.keys]
    return log.sweep(spark, store.commits, roots, min_age_seconds)


def load_name(*parts: str) -> str:
    return hashlib.md5("|".join(parts).encode()).hexdigest()[:16]


def missing_tables(spark: SparkSession, store: Store, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """(file, table) pairs of the wanted map that the ledger does not hold."""
    pairs = spark.createDataFrame([(f, t) for f, tables in wanted.items() for t in tables], LEDGER_SCHEMA)
    return pairs.join(ledger(spark, store), ["file", "table"], "left_anti")


def ledger_entries(ledger: DataFrame) -> DataFrame:
    """Ledger in one row per file: ``file, success_tables`` (a handful of table names per file)."""
    return ledger.groupBy("file").agg(F.array_sort(F.collect_set("table")).alias("success_tables"))


def clean_ledger(entries: DataFrame) -> DataFrame:
    """Keep in ``duplicates_removed`` only tables that were loaded."""
    return entries.withColumn("duplicates_removed", F.array_intersect("duplicates_removed", "success_tables"))


def deduplicated_tables(entries: DataFrame) -> DataFrame:
    """Names of tables that are already free of duplicates, one per row."""
    return entries.select(F.explode("duplicates_removed").alias("table")).distinct()


@contextmanager
def staged_records(
    lines: DataFrame, source: str, tables: Sequence[str], catalog: Catalog = DEFAULT_CATALOG
) -> Iterator[DataFrame]:
    """Lines parsed once into a Parquet copy, which is removed when the load has ended, also by an error.

    The copy holds the fields the given tables use. Only faulty lines keep their text.
    """
    spark = tune(lines.sparkSession)
    path = scratch_path(spark, f"staged-{source}")
    parsed = parse_records(lines, catalog.raw_fields(source, tables), catalog.key_width(tables))
    faulty_text = F.when(F.col("fault").isNotNull(), F.col("value"))
    try:
        parsed.withColumn("value", faulty_text).write.parquet(path)
        yield spark.read.parquet(path)
    finally:
        drop_scratch(spark, path)


def _rejected(rows: DataFrame, fault: Column, fields: Sequence[str]) -> DataFrame:
    """Rejected rows with their reason and their fields as JSON."""
    text = F.to_json(F.struct(*[f for f in fields if f in rows.columns]))
    return rows.select(fault.alias("fault"), text.alias("value"), *PLACE)


class StoredKeys:
    """Keys that other loads have published, asked through the filters beside them.

    Of each table only loads are asked whose key range meets that of the new rows.
    """

    def __init__(self, spark: SparkSession, store: Store, load_id: str, tables: Sequence[str], catalog: Catalog):
        self.spark, self.store, self.catalog = spark, store, catalog
        parts = log.published_parts(spark, store.commits)
        asked = parts.filter(F.col("name").isin(list(tables)) & (F.col("load_id") != load_id) & (F.col("rows") > 0))
        # A row for each load and table, as many as there are folders to list.
        self.parts = asked.collect()

    def known(self, rows: DataFrame, table: str) -> DataFrame | None:
        """Distinct keys (``key``) of ``rows`` that are stored; None where nothing can be."""
        of_table = [p for p in self.parts if p["name"] == table]
        if not of_table:
            return None
        keys = self.catalog.key(table)
        low, high = rows.agg(F.min(keys[0]), F.max(keys[0])).first()
        reach = [p for p in of_table if low is not None and p["low"].encode() <= high.encode() and low.encode() <= p["high"].encode()]
        if not reach:
            return None
        folders = [f"{self.store.keys}/{p['folder']}" for p in reach]
        part = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        filters = self.spark.read.schema(FILTER_SCHEMA).parquet(*folders).select(part.alias("part"), "name", "bucket", "bits").filter(F.col("name") == table)
        new = rows.select(key_text(keys).alias("key"))
        hits = possible_hits(new, filters, [(p["folder"], filter_size(p["rows"])) for p in reach])
        stored = self.spark.read.schema(self.catalog.schema(table)).parquet(*[f"{self.store.table(table)}/{p['folder']}" for p in reach])
        return hits.join(stored.select(key_text(keys).alias("key")), "key", "left_semi")


def _repeated_keys(rows: Mapping[str, DataFrame], stored: StoredKeys, catalog: Catalog) -> tuple[DataFrame, int]:
    """``table, key, stored`` of the keys that occur twice in the new rows or are stored already, and their number.

    One aggregation over all tables of a source; only keys are shuffled.
    """
    counted = []
    for table, found in rows.items():
        new = found.select(F.lit(table).alias("table"), key_text(catalog.key(table)).alias("key"), F.lit(1).alias("new"))
        counted.append(new)
        known = stored.known(found, table)
        if known is not None:
            counted.append(known.select(F.lit(table).alias("table"), "key", F.lit(0).alias("new")))
    groups = reduce(DataFrame.unionByName, counted).groupBy("table", "key").agg(F.sum("new").alias("n"), (F.min("new") == 0).alias("stored"))
    return counted_broadcast(groups.filter((F.col("n") > 1) | F.col("stored")).select("table", "key", "stored"))


def load_records(
    records: DataFrame,
    source: str,
    store: Store,
    commit: Commit,
    tables: Sequence[str],
    registry: CleanerRegistry,
    catalog: Catalog = DEFAULT_CATALOG,
    order: Sequence[str] = PLACE,
    on_duplicate: str = "fail",
    report_lines: bool = True,
) -> None:
    """Write the given tables of one staged load to the folders of ``commit``, whose parts they become; nothing is published.

    ``on_duplicate``: ``fail`` refuses a load that repeats a key, ``quarantine`` keeps the first row
    and sets the others aside, ``keep`` skips the check. ``report_lines``: set malformed lines aside, which an earlier load of
    other tables from the same lines has done already.
    """
    spark = records.sparkSession
    fields = catalog.raw_fields(source, tables)
    sound = records.filter(F.col("fault").isNull()).drop("fault")
    malformed = records.filter(F.col("fault") == MALFORMED).select("fault", "value", *PLACE)
    rejected = [malformed.withColumn("kind", F.lit(f"lines:{source}"))] if report_lines else []

    def reject(rows: DataFrame, table: str) -> None:
        rejected.append(rows.withColumn("kind", F.lit(table)))

    kept: dict[str, DataFrame] = {}
    for table in tables:
        keys = list(catalog.key(table))
        cleaned = sound.transform(registry.get(table))
        kept[table] = apply_skip_rule(cleaned, keys)
        faults = registry.faults(table)
        if faults is not None:
            reject(_rejected(faults(sound), F.col("fault"), fields), table)
        if table in catalog.computed_keys:
            reject(_rejected(left_out(cleaned, keys), F.lit("key_missing"), cleaned.columns), table)
        else:
            reject(_rejected(sound.filter(key_fault(keys)), F.lit("key_missing"), fields), table)

    sound_rows = dict(kept)
    stored = StoredKeys(spark, store, commit.load_id, tables, catalog)
    checked = [t for t in tables if t not in catalog.first_seen and on_duplicate != "keep"]
    repeated_in = None
    # Most loads repeat no key, and then no join is planned for it.
    repeated, n_repeated = _repeated_keys({t: kept[t] for t in checked}, stored, catalog) if checked else (None, 0)
    for table in checked if n_repeated else []:
        keys, rows = catalog.key(table), kept[table]
        suspects = rows.select(key_text(keys).alias("key"), *order).join(repeated.filter(F.col("table") == table).drop("table"), "key")
        first = first_seen(suspects.filter(~F.col("stored")), ["key"], order).select(*order)
        # A bit for each row, so that most often the rows themselves need no shuffle to find the copies among them.
        copies, n_copies = counted_broadcast(marked_rows(suspects.select(*order).join(first, list(order), "left_anti"), order))
        if n_copies:
            is_copy = with_mark(rows, copies, order, COPY)
            reject(_rejected(is_copy.filter(COPY).drop(COPY), F.lit("key_repeated"), fields), table)
            kept[table] = is_copy.filter(~F.col(COPY)).drop(COPY)
            repeated_in = repeated_in or table
    failed = on_duplicate == "fail" and repeated_in

    def reject_lost(table: str) -> None:
        reject(_rejected(lost_values(sound_rows[table], table, catalog), F.col("fault"), fields), table)

    for table in [] if failed else tables:
        keys = list(catalog.key(table))
        if table in catalog.first_seen:
            # Only the table's own columns enter the aggregate.
            typed = first_seen(project(kept[table], table, catalog, order), keys, order).drop(*order)
            known = stored.known(kept[table], table)
            if known is not None:
                typed = typed.join(known.select(F.col("key").alias("_known")), key_text(keys) == F.col("_known"), "left_anti")
            reject_lost(table)
            part, _ = _write_part(typed, table, store.table(table), keys, commit)
        else:
            # Whether any value is lost is seen while the rows are written; only then are they looked for.
            typed = project(kept[table], table, catalog, [loses_values(kept[table], table, catalog).alias(LOST)])
            part, lost = _write_part(typed, table, store.table(table), keys, commit)
            if lost or kept[table] is not sound_rows[table]:
                reject_lost(table)
        commit.parts.append(part)
    for table in tables if failed else []:
        reject_lost(table)
    if commit.parts:
        _write_filters(spark, store, commit, catalog)
    quarantine(reduce(DataFrame.unionByName, rejected), store.quarantine, f"{commit.load_id}-{commit.run}")
    if failed:
        raise DuplicateKeyError(f"{repeated_in}: a key occurs more than once, see {store.quarantine}")


def _write_part(rows: DataFrame, name: str, root: str, keys: Sequence[str], commit: Commit) -> tuple[Part, int]:
    """Write rows in key order; their number, their key range and how many have ``LOST`` set are taken while they are written."""
    seen = Observation()
    first = F.col(keys[0]).cast("string")
    lost = F.count_if(F.col(LOST)) if LOST in rows.columns else F.count_if(F.lit(False))
    laid_out = with_key_layout(rows, keys)
    observed = laid_out.observe(seen, F.count(F.lit(1)).alias("rows"), F.min(first).alias("low"), F.max(first).alias("high"), lost.alias("lost"))
    observed.drop(LOST).write.mode("overwrite").parquet(f"{root}/{commit.folder}")
    found = seen.get
    return Part(name, commit.folder, found["rows"], found["low"], found["high"]), found["lost"]


def _write_filters(spark: SparkSession, store: Store, commit: Commit, catalog: Catalog) -> None:
    """Key filters of all parts of a commit, in one job over the key columns just written."""
    made = []
    for part in commit.parts:
        keys = catalog.key(part.name)
        stored = spark.read.schema(catalog.schema(part.name)).parquet(f"{store.table(part.name)}/{part.folder}")
        made.append(key_filter(stored.select(key_text(keys).alias("key")), part.name, filter_size(part.rows)))
    reduce(DataFrame.unionByName, made).write.mode("overwrite").parquet(f"{store.keys}/{commit.folder}")


def counted_lines(lines: DataFrame) -> tuple[DataFrame, Observation]:
    """Lines whose number is known once they have been read."""
    seen = Observation()
    return lines.observe(seen, F.count(F.lit(1)).alias("lines")), seen


def load_source(
    spark: SparkSession,
    source: str,
    paths: str | Sequence[str],
    store: Store,
    registry: CleanerRegistry | None = None,
    catalog: Catalog = DEFAULT_CATALOG,
    max_lines: int | None = None,
    on_duplicate: str = "fail",
    system: str = "spark",
) -> list[str]:
    """Load the tables of a source that the ledger does not yet hold; returns the tables written.

    Several paths are one load, in path order. A load that ``max_lines`` may have cut short is not entered in the ledger:
    a later load reads the files again and replaces its rows. With a cap, only the files that hold the first lines are opened.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    data_file = ",".join(paths)
    version = log.last_version(spark, store.commits)
    wanted = missing_tables(spark, store, {data_file: catalog.sources[source].tables})
    # At most the tables of one source, a handful.
    todo = sorted((r["table"] for r in wanted.collect()), key=catalog.sources[source].tables.index)
    if not todo:
        return []
    commit = Commit(load_name(source, data_file), system, data_file, time.time())
    lines = read_lines(spark, paths) if max_lines is None else first_lines_of(spark, paths, max_lines, store.line_index)
    lines, counted = counted_lines(lines)
    with staged_records(lines, source, todo, catalog) as records:
        commit.line_count = counted.get["lines"]
        commit.complete = max_lines is None or commit.line_count < max_lines
        # Some tables are there already only where an earlier load has read the same lines.
        first_time = len(todo) == len(catalog.sources[source].tables) and ledger(spark, store).filter(F.col("file") == data_file).isEmpty()
        load_records(records, source, store, commit, todo, registry or default_cleaners(), catalog, on_duplicate=on_duplicate, report_lines=first_time)
        log.publish(spark, store.commits, commit, version)
    return todo


def load_archive(
    spark: SparkSession,
    files: Mapping[str, Sequence[str]],
    store: Store,
    registry: CleanerRegistry | None = None,
    catalog: Catalog = DEFAULT_CATALOG,
    max_lines: int | None = None,
    on_duplicate: str = "fail",
) -> dict[str, list[str]]:
    """Load every source of a map from source name to its dump files; returns the tables written.

    Files of a source are loaded one after the other, in the given order.
    """
    written: dict[str, list[str]] = {}
    for source, paths in files.items():
        for path in paths:
            written[path] = load_source(spark, source, path, store, registry, catalog, max_lines, on_duplicate)
    return written


def load_documents(
    spark: SparkSession,
    source: str,
    paths: str | Sequence[str],
    store: Store,
    catalog: Catalog = DEFAULT_CATALOG,
    max_lines: int | None = None,
) -> bool:
    """Keep the raw records of a source as documents; False when the ledger already holds the collection.

    The text is read and parsed once, into a staging copy that the layout, its key bounds and the quarantine read.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    data_file = ",".join(paths)
    collection = catalog.sources[source].collection
    name = f"documents/{collection}"
    version = log.last_version(spark, store.commits)
    if missing_tables(spark, store, {data_file: [name]}).isEmpty():
        return False
    commit = Commit(load_name("documents", source, data_file), "documents", data_file, time.time())
    lines = read_lines(spark, paths) if max_lines is None else first_lines_of(spark, paths, max_lines, store.line_index)
    keys = list(catalog.document_key(collection))
    lines, counted = counted_lines(lines)
    staged = scratch_path(spark, f"staged-documents-{source}")
    try:
        documents = read_documents(lines, keys)
        documents.withColumn("value", F.when(F.col("fault").isNotNull(), F.col("value"))).write.parquet(staged)
        documents = spark.read.schema(documents.schema).parquet(staged)
        commit.line_count = counted.get["lines"]
        commit.complete = max_lines is None or commit.line_count < max_lines
        faulty = documents.filter(F.col("fault").isNotNull()).select("fault", "value", *PLACE)
        quarantine(faulty.withColumn("kind", F.lit(collection)), store.quarantine, f"{commit.load_id}-{commit.run}")
        sound = documents.filter(F.col("fault").isNull()).select(*keys, "doc")
        commit.parts.append(_write_part(sound, name, store.documents(collection), keys, commit)[0])
        log.publish(spark, store.commits, commit, version)
    finally:
        drop_scratch(spark, staged)
    return True
