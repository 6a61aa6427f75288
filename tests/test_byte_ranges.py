import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from threadloom import registered
from threadloom.operators import manifest, profile
from threadloom.session import checkpoint_root
from threadloom.sources import byte_ranges, line_index
from threadloom.sources.ndjson import read_lines


@pytest.fixture
def raw(tmp_path):
    def write(name, data):
        path = tmp_path / "dump" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
        return str(path)

    return write


def texts():
    rng = random.Random(3)
    plain = b"".join(b"%d %s\n" % (i, b"x" * rng.randint(0, 30)) for i in range(60))
    mixed = b"".join(rng.choice([b"", b"a", "é\x0b\x0c".encode(), b"long" * 20]) + rng.choice([b"\n", b"\r", b"\r\n"]) for _ in range(80))
    return {"a": plain, "b": mixed, "c": b"no end", "d": b"", "e": b"\n\n\r\r\n\n", "f": b"\r", "g": b"x\r\ny"}


def lines_in(data):
    return [x.decode() for x in data.splitlines()]


@pytest.mark.parametrize("block", [1, 2, 7, 64, 1 << 20])
def test_blocks_give_every_line_once(spark, raw, tmp_path, monkeypatch, block):
    monkeypatch.setattr(byte_ranges, "READ_BYTES", max(3, block // 2))
    contents = texts()
    if block < 7:
        contents = {k: v[:90] if k == "b" else v for k, v in contents.items() if k != "a"}
    for name, data in contents.items():
        raw(name, data)
    files = byte_ranges.list_every_file(spark, str(tmp_path / "dump"))
    blocks = byte_ranges.blocks_of(files, block_bytes=block).coalesce(1)
    read = byte_ranges.lines_of(blocks, tasks=2).collect()
    got = {}
    for r in sorted(read, key=lambda r: (r.file_path, r.block_start, r.row_id)):
        got.setdefault(os.path.basename(r.file_path), []).append(r.value)
    assert got == {n: lines_in(d) for n, d in contents.items() if lines_in(d)}
    counts = byte_ranges.read_blocks(blocks, tasks=2).groupBy("path").agg(F.sum("line_starts").alias("n")).collect()
    assert {os.path.basename(r.path): r.n for r in counts} == {n: len(lines_in(d)) for n, d in contents.items() if d}
    # As many as Spark's reader finds.
    scanned = read_lines(spark, str(tmp_path / "dump")).groupBy("file_path").count().collect()
    assert {os.path.basename(r.file_path): r["count"] for r in scanned} == {n: len(lines_in(d)) for n, d in contents.items() if d}
    counted = {os.path.basename(r.path): r.line_count for r in profile.line_counts(spark, str(tmp_path / "dump")).collect()}
    assert counted == {n: len(lines_in(d)) for n, d in contents.items()}


def test_listing_has_empty_files(spark, raw, tmp_path):
    raw("a", b"x\n"), raw("empty", b""), raw("sub/b", b"y\n"), raw("sub/.hidden", b"y"), raw("_temporary/c", b"y"), raw("sub/deep/_x/d", b"y"), raw("sub/deep/e", b"")
    rows = byte_ranges.list_every_file(spark, str(tmp_path / "dump")).collect()
    root = f"file:{tmp_path}/dump/"
    assert {r.path.removeprefix(root): r.length for r in rows} == {"a": 2, "empty": 0, "sub/b": 2, "sub/deep/e": 0}
    flat = byte_ranges.list_every_file(spark, str(tmp_path / "dump"), recursive=False).collect()
    assert sorted(os.path.basename(r.path) for r in flat) == ["a", "empty"]
    (one,) = byte_ranges.list_every_file(spark, f"file://{tmp_path}/dump/empty").collect()
    assert one.length == 0


def test_first_lines_read_no_further(spark, raw, tmp_path):
    data = b"".join(b"line %d\n" % i for i in range(1000))
    raw("a", data), raw("b", b""), raw("c", b"".join(b"more %d\n" % i for i in range(1000)))
    stored, folder = str(tmp_path / "index"), str(tmp_path / "dump")
    index = line_index.LineIndex(spark, folder, stored, block_bytes=500)
    got = [r.value for r in index.first_lines(100).orderBy("file_path", "block_start", "row_id").collect()]
    assert got == [f"line {i}" for i in range(100)]
    # Doubling groups: at most twice the blocks that were needed have been counted, and nothing of the later file.
    counted = spark.read.parquet(stored)
    assert counted.count() <= 4 and {os.path.basename(r.path) for r in counted.collect()} == {"a"}
    os.remove(str(tmp_path / "dump" / "c"))
    again = line_index.LineIndex(spark, folder, stored, block_bytes=500)
    assert again.first_lines(100).count() == 100 and spark.read.parquet(stored).count() == counted.count()
    raw("c", b"".join(b"more %d\n" % i for i in range(1000)))
    whole = line_index.LineIndex(spark, folder, stored, block_bytes=500)
    assert [r.value for r in whole.line_at(1101).collect()] == ["more 100"]
    assert [r.value for r in whole.line_at(1000).collect()] == ["line 999"]
    assert whole.line_at(2001).count() == whole.line_at(0).count() == 0
    assert whole.first_lines(5000).count() == 2000 and whole.first_lines(0).count() == 0
    assert {os.path.basename(r.path): r.line_count for r in whole.line_counts().collect()} == {"a": 1000, "b": 0, "c": 1000}


def test_index_forgets_a_file_that_changed(spark, raw, tmp_path):
    stored, path = str(tmp_path / "index"), raw("a", b"one\ntwo\n")
    assert line_index.LineIndex(spark, path, stored).line_at(2).first().value == "two"
    raw("a", b"one\n2\nthree\n")
    assert line_index.LineIndex(spark, path, stored).line_at(2).first().value == "2"


def manifest_rows(spark, tmp_path, old=None, **more):
    """A manifest kept in a table, as a later one needs it, and its files."""
    path = str(tmp_path / f"manifest{len(list(tmp_path.glob('manifest*')))}")
    manifest.block_manifest(spark, str(tmp_path / "dump"), old, block_bytes=100, **more).write.parquet(path)
    blocks = spark.read.parquet(path)
    return blocks, {os.path.basename(r.path): r for r in manifest.file_manifest_of(blocks).collect()}


def test_a_file_that_grew_is_read_from_its_old_end(spark, raw, tmp_path):
    data = b"".join(b"line %d\n" % i for i in range(120))
    raw("grown", data), raw("kept", data), raw("rewritten", data), raw("emptied", data), raw("filled", b""), raw("edge", b"12345678\n9" * 10), raw("gone", b"x")
    blocks, old = manifest_rows(spark, tmp_path)
    assert old["kept"].line_count == 120 and old["kept"].hash == old["grown"].hash and old["kept"].bytes_read >= len(data)
    assert (old["filled"].line_count, old["filled"].bytes_read, old["edge"].line_count) == (0, 0, 11)
    raw("grown", data + b"tail\n"), raw("rewritten", b"LINE" + data[4:-6] + b"other\nand more\n"), raw("emptied", b""), raw("filled", b"x\ny"), raw("edge", b"12345678\n9" * 10 + b"0\n")
    os.remove(tmp_path / "dump" / "gone")
    raw("new", b"n\n")
    updated, now = manifest_rows(spark, tmp_path, blocks)
    _, fresh = manifest_rows(spark, tmp_path)
    assert {n: (r.line_count, r.hash) for n, r in now.items()} == {n: (r.line_count, r.hash) for n, r in fresh.items()}
    assert now["kept"].bytes_read == 0
    assert now["grown"].bytes_read <= 2 * 100 + 2 < fresh["grown"].bytes_read
    assert now["edge"].bytes_read <= 100 + 2 + 1 + 1
    assert now["rewritten"].bytes_read >= len(data)
    status = {os.path.basename(r.path): r.status for r in profile.compare_manifests(manifest.file_manifest_of(blocks), manifest.file_manifest_of(updated)).collect()}
    assert status == {"grown": "changed", "kept": "unchanged", "rewritten": "changed", "emptied": "changed", "filled": "changed", "edge": "changed", "gone": "gone", "new": "new"}


def test_files_that_grow_become_more_and_not_longer(spark, monkeypatch):
    monkeypatch.setattr(registered, "GROWING_LINES", 100)
    tables = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{tables}/events.parquet").count()
    before = set(glob.glob(f"{checkpoint_root(spark)}/growing-*"))
    found = [r.asDict() for r in registered.QUERIES["manifest_append"](spark, tables).collect()]
    assert found == [{"hash_method": "blocks", "lines": lines, "same_hash": 1, "tail_only": 1}]
    for root in set(glob.glob(f"{checkpoint_root(spark)}/growing-*")) - before:
        counts = spark.read.text(root).groupBy("part").count().collect()
        assert len(counts) == -(-lines // 100) and all(r["count"] <= 100 for r in counts)
