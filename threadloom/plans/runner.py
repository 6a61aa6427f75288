"""Runs suite queries and records time and row count as rows."""

from __future__ import annotations

import logging
import random
import time
from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from threadloom.plans.results import RUN_SCHEMA, recordable
from threadloom.plans.suite import SuiteQuery, Tables

LEDGER_SCHEMA = f"{RUN_SCHEMA}, loop int"


def measure(query: SuiteQuery, tables: Tables) -> tuple[float, int]:
    """Seconds and rows of one run. Every row is produced and counted on the executors, none is fetched."""
    seen = Observation()
    start = time.perf_counter()
    result = query.build(tables).observe(seen, F.count(F.lit(1)).alias("rows"))
    result.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start, seen.get.get("rows", 0)


def run_suite(
    spark: SparkSession,
    suite: Mapping[str, SuiteQuery],
    tables: Mapping[str, Tables],
    kinds: Iterable[str] | None = None,
    skip: Iterable[str] = (),
    loops: int = 1,
    seed: int | None = None,
    ledger: str | None = None,
) -> DataFrame:
    """Run the chosen query classes ``loops`` times on each named set of tables.

    The order of the table sets is shuffled in every loop. One row per run is returned; runs with an
    empty result and runs that failed are left out.

    With ``ledger``, a folder, each run is appended there when it ends, with the execution memory (KB) of its largest stage, and a
    suite that was broken off goes on after the last (loop, system, query) it holds. A run that failed is tried again.
    """
    order = random.Random(seed)
    wanted = [q for q in suite.values() if (kinds is None or q.kind in set(kinds)) and q.name not in set(skip)]
    done = recorded_runs(spark, ledger) if ledger else None
    # A row for each run, as many as this loop will make.
    known = set() if done is None else {(r["loop"], r["system"], r["query"]) for r in done.select("loop", "system", "query").collect()}
    rows = []
    for loop in range(loops):
        systems = list(tables)
        order.shuffle(systems)
        for system in systems:
            for query in wanted:
                if (loop, system, query.name) in known:
                    continue
                before = last_stage(spark) if ledger else 0
                try:
                    seconds, length = measure(query, tables[system])
                except PySparkException as error:
                    # A query that fails costs its own run only.
                    logging.getLogger(__name__).warning("%s on %s failed: %s", query.name, system, error)
                    continue
                if ledger:
                    run = (system, query.name, seconds, peak_memory(spark, before) / 1024, length, loop)
                    spark.createDataFrame([run], LEDGER_SCHEMA).coalesce(1).write.mode("append").parquet(ledger)
                else:
                    rows.append((system, query.name, seconds, None, length))
    if ledger:
        return recordable(recorded_runs(spark, ledger).drop("loop"))
    return recordable(spark.createDataFrame(rows, RUN_SCHEMA))


def recorded_runs(spark: SparkSession, ledger: str) -> DataFrame:
    """All runs of a ledger; none where nothing has been recorded."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(ledger)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def last_stage(spark: SparkSession) -> int:
    return max((stage.stageId() for stage in _stages(spark)), default=-1)


def peak_memory(spark: SparkSession, after: int) -> int:
    """Bytes of execution memory that the tasks of one stage held at most, over the stages begun since ``after``."""
    return max((stage.peakExecutionMemory() for stage in _stages(spark) if stage.stageId() > after), default=0)


def _stages(spark: SparkSession) -> list:
    """Spark's own records of stages: it keeps a bounded number of the last ones."""
    context = spark.sparkContext
    none = context._gateway.new_array(context._jvm.double, 0)
    found = context._jsc.sc().statusStore().stageList(None, False, False, none, context._jvm.java.util.ArrayList())
    return [found.apply(i) for i in range(found.size())]
