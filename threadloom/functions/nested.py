"""Walks over records of open schema and any depth.

The only Python in the data path. VARIANT keeps the keys of an object sorted, so it cannot tell which
of two equal leaf keys comes last in the record, and a chain of explodes fixes the depth in advance.
Both walks run as Arrow batches inside the scan's own tasks; the length walk reduces a batch to one
row per file and key before anything is shuffled.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Send the functions of this module to the executors with the plan, so that they need not have the
# package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Attributes whose nested content is not reported.
UNREPORTED_KEYS = ("_meta", "author_flair_richtext", "link_flair_richtext", "preview", "crosspost_parent_list")


def _refuse_constant(name: str):
    raise ValueError(name)


def _parse(line: str):
    try:
        return json.loads(line, parse_constant=_refuse_constant)
    except ValueError:
        return None


def leaf_values(record) -> dict:
    """Leaf key to value over objects and arrays; the last one in the record wins, bare array items are skipped."""
    leaves: dict = {}
    pending = [record]
    while pending:
        item = pending.pop()
        if isinstance(item, tuple):
            leaves[item[0]] = item[1]
        elif isinstance(item, dict):
            nested = (dict, list)
            pending.extend(v if isinstance(v, nested) else (k, v) for k, v in reversed(item.items()))
        elif isinstance(item, list):
            pending.extend(v for v in reversed(item) if isinstance(v, (dict, list)))
    return leaves


def nested_paths(record, unreported=UNREPORTED_KEYS) -> list[str]:
    """Paths of non-empty objects, one per object; ``[i]`` marks the array item a path goes through."""
    found: list[str] = []
    pending = [("", record)] if isinstance(record, (dict, list)) else []
    while pending:
        prefix, item = pending.pop()
        if isinstance(item, list):
            pending.extend((f"{prefix}[{i}].", v) for i, v in reversed(list(enumerate(item))) if isinstance(v, dict) and v)
            continue
        if not isinstance(item, dict):
            if isinstance(item, str):
                found.append(item)
            continue
        steps = []
        for key, value in item.items():
            if key in unreported:
                continue
            if isinstance(value, dict) and value:
                steps += [("", prefix + key), (f"{prefix}{key}.", value)]
            elif isinstance(value, list):
                for i, entry in enumerate(value):
                    if isinstance(entry, dict) and entry:
                        steps += [("", prefix + key), (f"{prefix}{key}[{i}].", entry)]
        pending.extend(reversed(steps))
    return found


def leaf_lengths(lines: DataFrame, group: str = "file_path") -> DataFrame:
    """Longest text per group and leaf key over all records of ``value``: ``group``, ``key``, ``max_length``.

    Lengths are those of the printed value, so NULL and true count four characters.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longest: dict = {}
            for name, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for key, value in leaf_values(_parse(line)).items():
                    length = len(str(value))
                    if length > longest.get((name, key), -1):
                        longest[(name, key)] = length
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([g for g, _ in longest], pa.string()),
                    pa.array([k for _, k in longest], pa.string()),
                    pa.array(list(longest.values()), pa.int32()),
                ],
                names=[group, "key", "max_length"],
            )

    measured = lines.select(group, "value").mapInArrow(measure, f"`{group}` string, key string, max_length int")
    return measured.groupBy(group, "key").agg(F.max("max_length").alias("max_length"))


def with_nested_paths(lines: DataFrame, column: str = "value", unreported=UNREPORTED_KEYS) -> DataFrame:
    """Add ``nested_paths``: the paths of non-empty nested objects of each record."""

    @F.pandas_udf("array<string>")
    def paths(text: pd.Series) -> pd.Series:
        return text.map(lambda line: nested_paths(_parse(line), unreported) if line is not None else [])

    return lines.withColumn("nested_paths", paths(F.col(column)))
