"""Stored line counts of the blocks of dump files, so that the first N lines or line N read only the blocks that hold them.

The index has one row for each block and grows block by block in path order: asked for the first N lines it counts further
blocks, in doubling groups, only until N lines are known. What it knows of a file is used as long as the file keeps its size and time.
New rows are appended to the stored index.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.sources.byte_ranges import BLOCK_BYTES, LINE_SCHEMA, blocks_of, lines_of, list_every_file, read_blocks

INDEX_SCHEMA = "path string, length bigint, modified timestamp, block_bytes bigint, number bigint, line_starts bigint"


@dataclass(frozen=True)
class IndexedBlock:
    """A block with the number of lines that start in it and of those before it."""

    path: str
    number: int
    start: int
    size: int
    lines: int
    before: int


class LineIndex:
    """Line counts of the files below ``paths``, kept at ``stored`` if that is given."""

    def __init__(
        self, spark: SparkSession, paths: str | Sequence[str], stored: str | None = None, recursive: bool = True, block_bytes: int = BLOCK_BYTES
    ):
        self.spark, self.stored, self.block_bytes = spark, stored, block_bytes
        # Names and sizes only, which the driver holds for every scan of these files. In order of UTF-8 bytes, as Spark sorts.
        found = list_every_file(spark, paths, recursive).collect()
        self.files = sorted(found, key=lambda r: r["path"].encode())
        self.counts: dict[tuple[str, int], int] = {}
        known = self._stored_rows()
        if known is not None:
            files = spark.createDataFrame(self.files, "path string, length bigint, modified timestamp") if self.files else None
            rows = known.filter(F.col("block_bytes") == block_bytes).join(files, ["path", "length", "modified"], "left_semi") if files else known.limit(0)
            # One row for each block of 64 MiB: under two million for 100 TB.
            self.counts = {(r["path"], r["number"]): r["line_starts"] for r in rows.collect()}

    def _stored_rows(self) -> DataFrame | None:
        if self.stored is None:
            return None
        try:
            return self.spark.read.schema(INDEX_SCHEMA).parquet(self.stored)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _blocks(self):
        """(file, number, start, size) of all blocks in order."""
        for f in self.files:
            for number, start in enumerate(range(0, f["length"], self.block_bytes)):
                yield f, number, start, min(self.block_bytes, f["length"] - start)

    def _count(self, blocks: Sequence[tuple]) -> None:
        """Count the line starts of some blocks in one job and keep them."""
        frame = self.spark.createDataFrame([(f["path"], n, start, size) for f, n, start, size in blocks], "path string, number bigint, start bigint, size bigint")
        found = {(r["path"], r["number"]): r["line_starts"] for r in read_blocks(frame, min(len(blocks), 4000)).select("path", "number", "line_starts").collect()}
        self.counts |= found
        if self.stored is not None:
            fresh = [(f["path"], f["length"], f["modified"], self.block_bytes, n, found[f["path"], n]) for f, n, _, _ in blocks]
            self.spark.createDataFrame(fresh, INDEX_SCHEMA).coalesce(1).write.mode("append").parquet(self.stored)

    def cover(self, lines: int | None = None) -> list[IndexedBlock]:
        """The blocks that hold the first ``lines`` lines (all blocks without it), in order."""
        blocks, out, total, at, group = list(self._blocks()), [], 0, 0, 1
        while at < len(blocks) and (lines is None or total < lines):
            f, number, start, size = blocks[at]
            if (f["path"], number) not in self.counts:
                ahead = blocks[at:] if lines is None else blocks[at : at + group]
                self._count([b for b in ahead if (b[0]["path"], b[1]) not in self.counts])
                group *= 2
            own = self.counts[f["path"], number]
            out.append(IndexedBlock(f["path"], number, start, size, own, total))
            total += own
            at += 1
        return out

    def _read(self, blocks: Sequence[IndexedBlock], first: int, last: int) -> DataFrame:
        """Lines ``first`` to ``last``, counted from 1 over all files, which lie in the given blocks."""
        rows = [(b.path, b.number, b.start, b.size, max(0, first - 1 - b.before), last - b.before) for b in blocks if b.lines and b.before < last and b.before + b.lines >= first]
        if not rows:
            return self.spark.createDataFrame([], LINE_SCHEMA)
        schema = "path string, number bigint, start bigint, size bigint, take_from bigint, take_to bigint"
        return lines_of(self.spark.createDataFrame(rows, schema), min(len(rows), 4000))

    def first_lines(self, count: int) -> DataFrame:
        """The first ``count`` lines over all files, with their place. What lies behind them is not read."""
        return self._read(self.cover(count), 1, count)

    def line_at(self, number: int) -> DataFrame:
        """Line ``number`` over all files, from 1; no row where there are fewer lines. Of a stored index one block is read."""
        return self._read(self.cover(number)[-1:] if number > 0 else [], number, number)

    def line_counts(self) -> DataFrame:
        """``path, line_count`` of every file, empty ones included."""
        totals = {f["path"]: 0 for f in self.files}
        for b in self.cover():
            totals[b.path] += b.lines
        return self.spark.createDataFrame(sorted(totals.items()), "path string, line_count bigint")


def first_lines_of(spark: SparkSession, paths: str | Sequence[str], count: int, stored: str | None = None) -> DataFrame:
    """The first ``count`` lines of a dump of one or several files; bad and blank lines count."""
    return LineIndex(spark, paths, stored).first_lines(count)
