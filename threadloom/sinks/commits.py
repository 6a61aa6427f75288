"""Commit log of a store: a load shows all its tables at one moment, or none of them.

A run of a load writes each table into a folder of its own and then publishes one commit, a small file that names these
folders. Readers take only folders a commit names, so neither a load in progress nor one that was killed shows a row, and a load that is run again
replaces its earlier rows for readers in the moment of its commit. Commits are numbered; the number of a commit is also the number of the
snapshot it makes, and older snapshots can be read until their folders are swept.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError

PART_SCHEMA = "struct<name: string, folder: string, rows: bigint, low: string, high: string>"
COMMIT_SCHEMA = (
    "version bigint, load_id string, run string, system string, data_file string, started double, ended double, "
    f"complete boolean, line_count bigint, parts array<{PART_SCHEMA}>"
)


class CommitConflict(RuntimeError):
    """Another load has published rows of the same tables since this one looked at the store."""


@dataclass(frozen=True)
class Part:
    """One folder of rows: the table's name, and the number and first and last key of its rows where they are known."""

    name: str
    folder: str
    rows: int | None = None
    low: str | None = None
    high: str | None = None


@dataclass
class Commit:
    """What one run of a load publishes. ``complete``: the files of the load have been read to their end."""

    load_id: str
    system: str
    data_file: str
    started: float
    run: str = field(default_factory=lambda: uuid.uuid4().hex[:12])
    ended: float | None = None
    complete: bool = True
    line_count: int = 0
    parts: list[Part] = field(default_factory=list)

    @property
    def folder(self) -> str:
        """Name of the folders this run writes."""
        return f"load_id={self.load_id}-{self.run}"


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def last_version(spark: SparkSession, log: str) -> int:
    """Number of the last commit, 0 where there is none. Names only are listed."""
    target, files = _files(spark, log)
    if not files.exists(target):
        return 0
    names = [s.getPath().getName() for s in files.listStatus(target)]
    return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)


def commits(spark: SparkSession, log: str, version: int | None = None) -> DataFrame:
    """Commits up to ``version`` (all by default). One that is still being written does not count."""
    if not last_version(spark, log):
        return spark.createDataFrame([], COMMIT_SCHEMA)
    found = spark.read.schema(COMMIT_SCHEMA).option("pathGlobFilter", "*.json").json(log)
    found = found.filter(F.col("version").isNotNull() & F.col("ended").isNotNull())
    return found if version is None else found.filter(F.col("version") <= version)


def published_parts(spark: SparkSession, log: str, version: int | None = None) -> DataFrame:
    """``name, load_id, folder, rows, low, high, version``: of every load and table the part published last."""
    parts = commits(spark, log, version).select("version", "load_id", F.inline("parts"))
    last = parts.groupBy("name", "load_id").agg(F.max_by(F.struct("folder", "rows", "low", "high", "version"), "version").alias("p"))
    return last.select("name", "load_id", "p.*")


def publish(spark: SparkSession, log: str, commit: Commit, seen: int) -> int:
    """Make the parts of ``commit`` visible; returns its number.

    ``seen`` is the number of the last commit when the load began. The next number is taken by creating a file that must not exist
    yet. If other loads have taken it, their tables are compared: with tables in common the rows written here may repeat theirs, and the commit is refused.
    """
    commit.ended = time.time()
    names = {p.name for p in commit.parts}
    number = seen + 1
    while True:
        target, files = _files(spark, f"{log}/{number:020d}.json")
        try:
            out = files.create(target, False)
        except Py4JJavaError as error:
            if not files.exists(target):
                raise
            _refuse_overlap(spark, log, number, names, commit.load_id, error)
            number += 1
            continue
        out.write((json.dumps({"version": number, **asdict(commit)}) + "\n").encode())
        out.close()
        return number


def _refuse_overlap(spark: SparkSession, log: str, number: int, names: set[str], load_id: str, error: Exception) -> None:
    for _ in range(50):
        taken = commits(spark, log).filter(F.col("version") == number).select("load_id", "parts.name").first()
        if taken is not None:
            if names & set(taken["name"]):
                raise CommitConflict(f"load {taken['load_id']} has published {sorted(names & set(taken['name']))} meanwhile; run {load_id} again") from error
            return
        time.sleep(0.1)  # its writer has made the file but not filled it
    # The other writer died in between; its number stays void.


def read_published(spark: SparkSession, log: str, root: str, name: str, schema=None, version: int | None = None) -> DataFrame | None:
    """Published rows of a table below ``root``, or None if there are none. Only the named folders are listed.

    The driver holds one folder name for each load, less than the file listing of the same scan.
    """
    found = published_parts(spark, log, version).filter(F.col("name") == name).select("folder").collect()
    if not found:
        return None
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*[f"{root}/{r['folder']}" for r in sorted(found)])


def sweep(spark: SparkSession, log: str, roots: Sequence[str], min_age_seconds: float = 24 * 3600) -> list[str]:
    """Remove run folders below the roots that no current part names and that have not changed for ``min_age_seconds``.

    The age keeps loads in progress, and readers of a snapshot that was replaced lately, from losing their files.
    """
    kept = {r["folder"] for r in published_parts(spark, log).select("folder").distinct().collect()}
    removed, now = [], time.time()
    for root in roots:
        target, files = _files(spark, root)
        if not files.exists(target):
            continue
        for status in files.listStatus(target):
            name = status.getPath().getName()
            if name.startswith("load_id=") and name not in kept and now - status.getModificationTime() / 1000 >= min_age_seconds:
                files.delete(status.getPath(), True)
                removed.append(f"{root}/{name}")
    return removed
