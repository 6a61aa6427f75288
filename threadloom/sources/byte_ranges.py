"""Dump files by byte ranges: a listing that has empty files too, line counts and digests of fixed blocks, lines of chosen blocks.

Spark's own readers open a file as a whole and leave empty ones out. Here tasks read the ranges they are given through Arrow's file systems
(local, HDFS and the common object stores), so that a capped load reads the beginning of a dump only, and a dump that grew is read from its old end.

A line belongs to the block its first byte is in. Lines end with LF, CR or CRLF, as for Spark's text reader.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Send what this module defines to the executors with the plan, so that they need not have the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value of every stored index and manifest: bytes of a block.
BLOCK_BYTES = 64 * 1024**2
# Read at a time inside a block, and when a line runs on beyond its block.
READ_BYTES = 8 * 1024**2
BATCH_LINES = 2000

LISTING_SCHEMA = "path string, length bigint, modified timestamp"
LINE_SCHEMA = "value string, file_path string, block_start bigint, row_id bigint"
COUNT_SCHEMA = "path string, number bigint, start bigint, size bigint, line_starts bigint, digest string, checked string, bytes_read bigint"


def _plain(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a path, and the path inside it."""
    if "://" not in path or path.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(_plain(path))
    return pafs.FileSystem.from_uri(path)


def _shown(root: str, inside: str) -> str:
    """A found path with the scheme of its root; local paths as Spark's listing writes them."""
    if "://" not in root or root.startswith("file:"):
        return "file:" + inside
    return root.split("://")[0] + "://" + inside


class _Folder(InputPartition):
    def __init__(self, root: str, inside: str, recursive: bool):
        self.root, self.inside, self.recursive = root, inside, recursive


class FileListing(DataSource):
    """``path, length, modified`` of all files below the roots, empty ones included; one task for each folder below a root.

    Names that begin with a dot or an underscore are left out, with all below them, as Spark does.
    """

    @classmethod
    def name(cls) -> str:
        return "dump_files"

    def schema(self) -> str:
        return LISTING_SCHEMA

    def reader(self, schema) -> FileListingReader:
        return FileListingReader(self.options)


class FileListingReader(DataSourceReader):
    def __init__(self, options):
        self.roots, self.recursive = options["roots"].split("\n"), options.get("recursive", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        out = []
        for root in self.roots:
            files, inside = file_system(root)
            out.append(_Folder(root, inside, False))
            if self.recursive and files.get_file_info(inside).type == pafs.FileType.Directory:
                below = files.get_file_info(pafs.FileSelector(inside))
                out += [_Folder(root, f.path, True) for f in below if f.type == pafs.FileType.Directory and f.base_name[0] not in "._"]
        return out

    def read(self, partition: _Folder) -> Iterator[pa.RecordBatch]:
        files, _ = file_system(partition.root)
        own = files.get_file_info(partition.inside)
        found = [own] if own.type == pafs.FileType.File else files.get_file_info(pafs.FileSelector(partition.inside, recursive=partition.recursive))
        rows = [
            (_shown(partition.root, f.path), f.size, f.mtime)
            for f in found
            if f.type == pafs.FileType.File and (f is own or not any(p[0] in "._" for p in f.path[len(partition.inside) :].strip("/").split("/")))
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.timestamp("us", "UTC"))],
            names=["path", "length", "modified"],
        )


def list_every_file(spark: SparkSession, roots: str | Sequence[str], recursive: bool = True) -> DataFrame:
    """All files below the roots, or the roots themselves where they are files."""
    spark.dataSource.register(FileListing)
    roots = [roots] if isinstance(roots, str) else list(roots)
    return spark.read.format("dump_files").option("roots", "\n".join(roots)).option("recursive", str(recursive).lower()).load()


def blocks_of(files: DataFrame, first: str = "0", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``path, number, start, size`` of the blocks of each file, from number ``first`` (an expression) on; none of an empty file."""
    numbers = F.expr(f"filter(sequence(0L, length div {block_bytes}), n -> n * {block_bytes} < length AND n >= {first})")
    placed = files.select("*", F.explode(numbers).alias("number"))
    start = F.col("number") * block_bytes
    return placed.withColumns({"start": start, "size": F.least(F.lit(block_bytes), F.col("length") - start)})


def _pieces(source, start: int, stop: int) -> Iterator[bytes]:
    while start < stop:
        data = source.read_at(min(READ_BYTES, stop - start), start)
        if not data:
            return
        yield data
        start += len(data)


def read_blocks(blocks: DataFrame, tasks: int | None = None) -> DataFrame:
    """Line starts and digest of each block. With a column ``check``, also the digest of that many first bytes of the block.

    ``bytes_read`` says what was read. Blocks are dealt evenly, however long their files are.
    """
    check = F.col("check") if "check" in blocks.columns else F.lit(None)
    blocks = blocks.select("path", "number", "start", "size", check.cast("bigint").alias("check"))
    dealt = blocks.repartition(tasks or blocks.sparkSession.sparkContext.defaultParallelism * 4, "path", "number")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                files, inside = file_system(row["path"])
                start, stop = row["start"], row["start"] + row["size"]
                digest, checked, left = xxhash.xxh3_128(), xxhash.xxh3_128(), row["check"] or 0
                with files.open_input_file(inside) as source:
                    before = source.read_at(1, start - 1) if start else b""
                    starts, read = int(start == 0), len(before)
                    for data in _pieces(source, start, stop):
                        digest.update(data)
                        if left > 0:
                            checked.update(data[:left])
                            left -= len(data)
                        # Starts behind a LF, or behind a CR that no LF follows, inside what has been read.
                        both = before + data
                        starts += both[:-1].count(b"\n") + both[:-1].count(b"\r") - both.count(b"\r\n")
                        before, read = data[-1:], read + len(data)
                out.append((row["path"], row["number"], start, row["size"], starts, digest.hexdigest(), checked.hexdigest() if row["check"] else None, read))
            columns = zip(*out, strict=True) if out else [[]] * 8
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in COUNT_SCHEMA.split(", ")])

    return dealt.mapInArrow(rows, COUNT_SCHEMA)


def lines_of(blocks: DataFrame, tasks: int | None = None) -> DataFrame:
    """The lines that start in the given blocks, with their place: ``row_id`` counts inside the block.

    A last line is read on beyond its block. ``take_from`` and ``take_to``, if there, are the first row to take and the one after the last.
    """
    bounds = [F.coalesce(F.col(c), F.lit(d)) if c in blocks.columns else F.lit(d) for c, d in (("take_from", 0), ("take_to", 1 << 62))]
    blocks = blocks.select("path", "number", "start", "size", bounds[0].cast("bigint").alias("take_from"), bounds[1].cast("bigint").alias("take_to"))
    dealt = blocks.repartition(tasks or blocks.sparkSession.sparkContext.defaultParallelism * 4, "path", "number")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _block_lines(row)

    return dealt.mapInArrow(rows, LINE_SCHEMA)


def _lines_from(source, place: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(place, line with its end) from ``place`` on. The last one read is held back until it is known how it ends."""
    at, held = place, b""
    while True:
        data = source.read_at(min(READ_BYTES, max(stop - at, 64 * 1024)), at)
        at += len(data)
        lines = (held + data).splitlines(keepends=True)
        held = lines.pop() if data and lines else b""
        for line in lines:
            yield place, line
            place += len(line)
        if not data:
            return


def _block_lines(row: dict) -> Iterator[pa.RecordBatch]:
    files, inside = file_system(row["path"])
    start, stop, out = row["start"], row["start"] + row["size"], []

    def batch() -> pa.RecordBatch:
        text = pa.array([line.decode("utf-8", "replace") for line, _ in out], pa.string())
        places = [pa.array([row["path"]] * len(out), pa.string()), pa.array([start] * len(out), pa.int64()), pa.array([n for _, n in out], pa.int64())]
        return pa.RecordBatch.from_arrays([text, *places], names=["value", "file_path", "block_start", "row_id"])

    with files.open_input_file(inside) as source:
        before = source.read_at(1, start - 1) if start else b"\n"
        # The rest of a line of the block before, or the LF of a CRLF that the border parts.
        skip = before != b"\n" and (before != b"\r" or source.read_at(1, start) == b"\n")
        number = 0
        for place, line in _lines_from(source, start, stop):
            if skip:
                skip = False
                continue
            if place >= stop or number >= row["take_to"]:
                break
            if number >= row["take_from"]:
                # Of its end a line holds no CR or LF.
                out.append((line.rstrip(b"\r\n"), number))
                if len(out) == BATCH_LINES:
                    yield batch()
                    out.clear()
            number += 1
    if out:
        yield batch()
