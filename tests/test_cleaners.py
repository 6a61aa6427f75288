import hashlib

import pytest
from pyspark.sql import functions as F

from threadloom.catalog import DEFAULT_CATALOG, KEYS, SOURCES
from threadloom.operators import cleaners
from threadloom.sources.lists import DEFAULT_IGNORED_NAMES, default_ignore_list, read_ignore_list
from threadloom.sources.ndjson import parse_records, read_documents, read_lines


def cleaned(spark, path, source, table, registry=None):
    records = parse_records(read_lines(spark, path), DEFAULT_CATALOG.raw_fields(source))
    sound = records.filter(F.col("fault").isNull())
    rows = cleaners.clean_table(sound, table, registry or cleaners.default_cleaners())
    return cleaners.project(rows, table).collect()


def test_catalogue_is_complete(spark):
    assert len(KEYS) == 15
    assert sum(len(DEFAULT_CATALOG.schema(t)) for t in KEYS) == 204
    assert {t for s in SOURCES.values() for t in s.tables} == set(KEYS)
    for table, keys in KEYS.items():
        assert set(keys) <= set(DEFAULT_CATALOG.schema(table).names)


def test_faulty_lines(spark, dump):
    path = dump(
        "f",
        [
            '{"id": 1}', "", "   ", "no json", '{"id": 1} tail', '{"id": 1}{"id": 2}', "[1]", "12", '{"id": "x"',
            "{'id': 1}", '{"id": NaN}', '{"id": 3, "id": 4}',
        ],
    )
    rows = parse_records(read_lines(spark, path), ["id"]).orderBy("row_id").collect()
    faults = [r.fault for r in rows]
    bad = "malformed_json"
    assert faults == [None, "blank_line", "blank_line", bad, bad, bad, bad, bad, bad, bad, bad, None]
    assert rows[-1].id == "4"


def test_missing_and_extra_keys_and_nested_values(spark, dump):
    path = dump("s", [{"id": "a", "name": "t3_a", "content_categories": ["x", {"y": 1}], "unknown": 1, "title": "n\0l"}])
    (row,) = cleaned(spark, path, "submissions", "post")
    assert row.content_categories == '["x",{"y":1}]'
    assert row.title == "nl"
    assert row.score is None
    assert not hasattr(row, "unknown")


@pytest.mark.parametrize(
    "value, expected",
    [(False, False), (True, True), (0, False), (1735689600.0, True), (0.4, False), (None, None)],
)
def test_edited(spark, dump, value, expected):
    path = dump("s", [{"id": "a", "name": "t3_a", "edited": value, "score": 1}])
    (row,) = cleaned(spark, path, "submissions", "post")
    assert row.edited is expected


def test_lenient_typing_and_lost_values(spark, dump):
    lines = [
        {"name": "a", "score": "12", "created_utc": 1735689600.0, "upvote_ratio": 1, "archived": 1, "gilded": 0},
        {"name": "b", "score": "many", "archived": "perhaps"},
    ]
    path = dump("s", lines)
    first, second = sorted(cleaned(spark, path, "submissions", "post"), key=lambda r: r.name)
    assert (first.score, first.created_utc, first.upvote_ratio, first.archived, first.gilded) == (12, 1735689600, 1.0, True, False)
    assert second.score is None and second.archived is None
    records = parse_records(read_lines(spark, path), DEFAULT_CATALOG.raw_fields("submissions"))
    (lost,) = cleaners.lost_values(records, "post").select("name", "fault").collect()
    assert (lost.name, lost.fault) == ("b", "bad_value:archived,score")


def test_skip_rule(spark, dump):
    lines = [
        {"id": None, "body": "x"},
        {"id": "", "body": "x"},
        {"body": "x"},
        {"id": "only-key"},
        {"id": "empty", "body": "", "score": None},
        {"id": "outside", "body": "", "not_a_column": 0},
        {"id": "empty-list", "not_a_column": []},
        {"id": "kept", "body": "x"},
    ]
    rows = cleaned(spark, dump("c", lines), "comments", "comment")
    assert sorted(r.id for r in rows) == ["empty-list", "kept", "outside"]


def test_author_ignore_list(spark, dump, tmp_path):
    (tmp_path / "names").write_text(" AutoModerator \nSome_Bot\n\n")
    registry = cleaners.default_cleaners(read_ignore_list(spark, str(tmp_path / "names")))
    lines = [
        {"author": "\tautomoderator ", "author_fullname": "t2_a", "name": "1"},
        {"author": "some_bot", "author_fullname": "t2_b", "name": "2"},
        {"author": "person", "author_fullname": "t2_c", "name": "3"},
        {"author": "[deleted]", "name": "4"},
        {"author": None, "author_fullname": "t2_d", "name": "5"},
    ]
    path = dump("s", lines)
    assert sorted(r.author_fullname for r in cleaned(spark, path, "submissions", "author", registry)) == ["t2_c", "t2_d"]
    assert len(cleaned(spark, path, "submissions", "post", registry)) == 5


def test_default_ignore_list(spark):
    names = {r.name for r in default_ignore_list(spark).collect()}
    assert len(DEFAULT_IGNORED_NAMES) == 174
    assert {"[deleted]", "automoderator", "hippobot9000"} <= names


def test_distinguished_filter_only_on_posts(spark, dump):
    lines = [{"id": "a", "name": "a", "distinguished": None, "score": 1}, {"id": "b", "name": "b", "distinguished": "mod"}]
    path = dump("x", lines)
    assert [r.id for r in cleaned(spark, path, "submissions", "distinguished_post")] == ["b"]
    assert len(cleaned(spark, path, "comments", "distinguished_comment")) == 2
    assert len(cleaned(spark, path, "comments", "collapsed_comment")) == 2


def test_rules(spark, dump):
    rule = {"priority": 0, "short_name": "Be kind", "description": None, "kind": "all", "created_utc": 5.0}
    lines = [
        {"subreddit": "s", "rules": [rule, {**rule, "priority": 1, "rule_id": "own"}]},
        {"subreddit": "none", "rules": []},
        {"subreddit": None, "rules": [{"kind": None}, None]},
    ]
    rows = cleaned(spark, dump("r", lines), "subreddit_rules", "subreddit_rules")
    by_id = {r.rule_id: r for r in rows}
    assert set(by_id) == {hashlib.md5(b"s_0_Be kind_None").hexdigest(), "own"}
    assert by_id["own"].priority == 1 and by_id["own"].created_utc == 5 and by_id["own"].subreddit == "s"


def test_wiki(spark, dump):
    lines = [
        {"path": "/r/spark/wiki/a", "content": "é" * 501, "revision_date": "2025-01-01T00:00:00.900Z", "retrieved_on": 1},
        {"path": "/user/x", "content": "c", "revision_date": "2025-01-01T00:00:00Z"},
        {"path": "/r/bad", "content": "c", "revision_date": "yesterday"},
    ]
    path = dump("w", lines)
    (row,) = cleaned(spark, path, "subreddit_wikis", "wiki")
    assert (row.subreddit, row.revision_date, row.content) == ("spark", 1735689600, "é" * 501)
    records = parse_records(read_lines(spark, path), DEFAULT_CATALOG.raw_fields("subreddit_wikis"))
    assert [r.path for r in cleaners.wiki_faults(records).collect()] == ["/r/bad"]
    assert len(cleaned(spark, path, "subreddit_wikis", "revision_wiki")) == 3


def test_user_cleaner(spark, dump):
    registry = cleaners.default_cleaners()
    registry.register("comment", lambda df: df.filter(F.col("score").cast("int") > 1).withColumn("body", F.upper("body")))
    path = dump("c", [{"id": "a", "score": 1, "body": "x"}, {"id": "b", "score": 2, "body": "x"}])
    (row,) = cleaned(spark, path, "comments", "comment", registry)
    assert (row.id, row.body) == ("b", "X")
    assert registry.get("no_such_table") is cleaners.keep


def test_parse_runs_once(spark, dump):
    """The parse must not be copied into the conditions of the skip rule."""
    records = parse_records(read_lines(spark, dump("c", [{"id": "a", "score": 1}])), DEFAULT_CATALOG.raw_fields("comments"))
    rows = cleaners.project(cleaners.clean_table(records, "comment", cleaners.default_cleaners()), "comment")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(ArrayType(StructType") == 1


def test_documents(spark, dump):
    path = dump("d", ['{"name": "a", "x": {"y": [1, 2]}}', "", "bad", '{"name": "b", "z": 1, "z": 2}'])
    rows = read_documents(read_lines(spark, path), ["name"])
    found = rows.select("name", "fault", F.expr("try_variant_get(doc, '$.x.y[1]', 'int')").alias("y")).collect()
    assert sorted((r.name or "", r.fault or "", r.y or 0) for r in found) == [
        ("", "malformed_json", 0), ("", "malformed_json", 0), ("a", "", 2),
    ]
