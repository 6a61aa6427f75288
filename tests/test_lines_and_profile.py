import json
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.functions.nested import leaf_values, nested_paths, with_nested_paths
from threadloom.operators import profile
from threadloom.sinks.json_files import export_batches, export_first_lines
from threadloom.sources import numbering
from threadloom.sources.ndjson import find_plain_files, read_json_document, read_lines


@pytest.fixture(params=[300, 1000, 10_000_000])
def split_bytes(request, spark):
    """Read files in many, some or single splits."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], str(request.param))
    spark.conf.set(keys[1], "1")
    yield request.param
    for key, value in before.items():
        spark.conf.set(key, value)


def numbered_file(dump, name, count):
    return dump(name, [f'{{"n": {i}, "pad": "{"x" * (i % 37)}"}}' for i in range(1, count + 1)])


def number_of(rows):
    return sorted((os.path.basename(r.file_path), json.loads(r.value)["n"]) for r in rows)


def test_line_numbers_at_any_split_size(spark, dump, split_bytes):
    paths = [numbered_file(dump, "a", 200), numbered_file(dump, "b", 90), numbered_file(dump, "c", 7)]
    lines = read_lines(spark, paths)
    rows = numbering.number_lines(lines).collect()
    assert len(rows) == 297
    assert all(json.loads(r.value)["n"] == r.line_no for r in rows)
    across = numbering.number_lines(lines, across_files=True).orderBy("line_no").collect()
    assert [r.line_no for r in across] == list(range(1, 298))
    assert [json.loads(r.value)["n"] for r in across] == [*range(1, 201), *range(1, 91), *range(1, 8)]


def test_first_lines_and_line_at(spark, dump, split_bytes):
    lines = read_lines(spark, [numbered_file(dump, "a", 200), numbered_file(dump, "c", 7)])
    first = numbering.first_lines(lines, 50).collect()
    assert number_of(first) == [("a", n) for n in range(1, 51)] + [("c", n) for n in range(1, 8)]
    assert number_of(numbering.line_at(lines, 120).collect()) == [("a", 120)]
    assert numbering.line_at(lines, 201).count() == 0
    assert [json.loads(r.value)["n"] for r in numbering.line_at(lines, 203, across_files=True).collect()] == [3]


def test_fingerprint_is_order_sensitive_and_split_independent(spark, dump):
    text = [f"line {i % 50} {'y' * (i % 11)}" for i in range(400)]
    swapped = [text[1], text[0], *text[2:]]
    paths = [dump("same", text), dump("copy", text), dump("swapped", swapped), dump("shorter", text[:-1])]

    def fingerprints():
        rows = profile.content_fingerprints(read_lines(spark, paths)).collect()
        return {os.path.basename(r.path): (r.line_count, r.hash) for r in rows}

    whole = fingerprints()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        split = fingerprints()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert whole == split
    assert whole["same"] == whole["copy"]
    assert len({h for _, h in whole.values()}) == 3


def test_line_counts(spark, dump):
    paths = [dump("a", ["x", "", "y"]), dump("b", [""]), dump("empty", [])]
    counts = {os.path.basename(r.path): r.line_count for r in profile.line_counts(spark, paths).collect()}
    assert counts == {"a": 3, "b": 1, "empty": 0}


def test_find_plain_files(spark, dump, tmp_path):
    dump("one", ["x"], "root/sub")
    dump("two.txt", ["x"], "root/sub")
    dump("three", ["x"], "root/has.dot")
    found = find_plain_files(spark, str(tmp_path / "root")).collect()
    assert [os.path.basename(r.path) for r in found] == ["one"]


def test_change_detection(spark, dump, tmp_path):
    paths = {n: dump(n, [n, "line"]) for n in ("kept", "edited", "removed", "touched", "emptied")}
    old = profile.file_manifest(spark, list(paths.values()))
    old_rows = spark.createDataFrame(old.collect(), old.schema)
    dump("edited", ["edited", "another"])
    os.utime(paths["touched"], (1, 1))
    dump("emptied", [])
    now = [paths["kept"], paths["edited"], paths["touched"], paths["emptied"], dump("added", ["a"])]
    new = profile.update_manifest(spark, old_rows, now)
    status = {os.path.basename(r.path): r.status for r in profile.compare_manifests(old_rows, new).collect()}
    assert status == {"kept": "unchanged", "touched": "unchanged", "edited": "changed", "emptied": "changed", "removed": "gone", "added": "new"}
    refreshed = {os.path.basename(r.path): r.line_count for r in profile.refresh_manifest(old_rows, new).collect()}
    assert refreshed == {"kept": 2, "touched": 2, "edited": 2, "emptied": 0, "added": 1}


def test_fingerprint_method_holds_for_every_file(spark, dump):
    path = dump("a", ["x", "y"])
    (content,) = profile.file_manifest(spark, path).collect()
    (metadata,) = profile.file_manifest(spark, path, method=profile.PARTIAL).collect()
    os.utime(path, (1, 1))
    (later,) = profile.file_manifest(spark, path).collect()
    (moved,) = profile.file_manifest(spark, path, method=profile.PARTIAL).collect()
    (empty,) = profile.file_manifest(spark, dump("empty", [])).collect()
    assert (empty.line_count, empty.length) == (0, 0)
    assert (content.line_count, content.hash_method, metadata.hash_method) == (2, "content", "metadata")
    assert content.hash == later.hash and metadata.hash != moved.hash


def test_max_lengths(spark, dump):
    first = {"a": "x" * 9, "b": {"a": "xx", "c": None}, "d": [], "e": ["long scalar in a list", {"f": True}], "g": 1735689600.0}
    path = dump("p", [first, "", "not json", {"a": "xxxx", "h": [[{"i": "abc"}]]}, {"a": "y" * 50}])
    lengths = {r.key: r.max_length for r in profile.max_lengths(spark, path, max_lines=4).collect()}
    # The later, nested "a" replaces the first one.
    assert lengths == {"a": 4, "c": 4, "f": 4, "g": 12, "i": 3}
    assert {r.key: r.max_length for r in profile.max_lengths(spark, path).collect()}["a"] == 50


def test_nested_paths(spark):
    record = {
        "user": {"id": 1, "device": {"os": "x"}}, "tags": [{"t": 1}, {}, {"t": {"u": 2}}], "empty": {},
        "preview": {"image": {"url": "x"}}, "plain": [1, 2],
    }
    expected = ["user", "user.device", "tags", "tags", "tags[2].t"]
    assert nested_paths(record) == expected
    lines = spark.createDataFrame([(json.dumps(record),), ('"text"',), ("bad",), (None,)], "value string")
    assert [r.nested_paths for r in with_nested_paths(lines).collect()] == [expected, [], [], []]


json_values = st.recursive(
    st.none() | st.booleans() | st.integers(-99, 99) | st.text("ab", max_size=3),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.sampled_from("abcd"), inner, max_size=4),
    max_leaves=20,
)


@settings(max_examples=200, deadline=None)
@given(json_values)
def test_leaf_values_agree_with_document_order(record):
    leaves = {}

    def visit(value, key=None):
        if isinstance(value, dict):
            for k, v in value.items():
                visit(v, k)
        elif isinstance(value, list):
            for v in value:
                visit(v)
        elif key is not None:
            leaves[key] = value

    visit(record)
    assert leaf_values(record) == leaves


def test_exports(spark, dump, tmp_path):
    path = dump("a", ['{"id": 1}', "bad", '{"id": 2}', '{"id": 3}'])
    lines = read_lines(spark, path)
    export_first_lines(lines, str(tmp_path / "first"), 3)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "first")).collect()) == ['{"id": 1}', '{"id": 2}']
    export_batches(lines, str(tmp_path / "batches"), records_per_file=3)
    files = [f for f in os.listdir(tmp_path / "batches") if f.endswith(".json")]
    assert len(files) == 2
    assert spark.read.json(str(tmp_path / "batches")).count() == 4


def test_json_document(spark, tmp_path):
    (tmp_path / "array.json").write_text('[\n {"a": 1},\n {"a": 2}\n]')
    rows = read_json_document(spark, str(tmp_path / "array.json"), "a int").collect()
    assert sorted(r.a for r in rows) == [1, 2]


def test_storage_sizes(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "t"))
    expected = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    (row,) = profile.storage_sizes(spark, {"t": str(tmp_path / "t")}).collect()
    assert row.size_bytes == expected
