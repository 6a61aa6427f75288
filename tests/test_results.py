import json

import pytest

from threadloom import standins
from threadloom.functions import scalars as S
from threadloom.plans import results
from threadloom.plans.runner import run_suite
from threadloom.plans.suite import SQL_SUITE
from threadloom.sinks.tables import with_key_layout
from pyspark.sql import functions as F


@pytest.fixture
def runs(spark):
    rows = [
        ("a", "simple_x", 1.0, 1024.0, 5), ("a", "simple_x", 3.0, 3072.0, 5), ("a", "simple_y", 5.0, 0.0, 1),
        ("b", "simple_x", 10.0, 0.0, 5), ("b", "simple_y", 20.0, 0.0, 2), ("b", "join_z", 7.0, 0.0, 3),
        ("c", "simple_x", 4.0, 0.0, 5), ("a", "join_z", 6.0, 0.0, 3), ("c", "join_z", 1.0, 0.0, 3), ("c", "join_z", 1.0, 0.0, 4),
    ]
    return spark.createDataFrame(rows, results.RUN_SCHEMA)


SYSTEMS = ["a", "b", "c"]


def by_key(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_means(runs):
    means = by_key(results.query_means(runs, SYSTEMS), "query")
    assert means["simple_x"]["a"] == 2.0 and means["simple_y"]["c"] is None
    assert by_key(results.query_means(runs, SYSTEMS, "memory"), "query")["simple_x"]["a"] == 2.0
    categories = by_key(results.category_means(runs, SYSTEMS), "category")
    assert categories["simple"] == {"category": "simple", "a": 3.5, "b": 15.0, "c": 4.0}


def test_too_slow(runs):
    bounded = by_key(results.bounded_query_means(runs, SYSTEMS), "query")
    assert bounded["simple_y"]["c"] == 20.0 and bounded["simple_y"]["c_too_slow"] is True
    assert bounded["simple_x"]["c"] == 4.0 and bounded["simple_x"]["c_too_slow"] is False
    categories = by_key(results.bounded_category_means(runs, SYSTEMS), "category")
    assert categories["simple"]["c"] == 15.0 and categories["simple"]["c_too_slow"] is True
    assert categories["join"]["c"] == 1.0 and categories["join"]["c_too_slow"] is False


def test_consistency(runs):
    assert [(r.query, r.system) for r in results.varying_lengths(runs).collect()] == [("join_z", "c")]
    unequal = by_key(results.unequal_lengths(runs), "query")
    assert {q: r["unshared_lengths"] for q, r in unequal.items()} == {"simple_y": 2, "join_z": 1}


def test_import_times(spark):
    rows = [("a", "data/x/one", 5, 100), ("a", "data/x/two", 7, 10), ("b", "data/x/one", 0, 100)]
    loads = spark.createDataFrame(rows, "system string, data_file string, time_elapsed_seconds bigint, line_count bigint")
    table = by_key(results.import_times(loads, ["one", "two"]), "system")
    assert table["a"] == {"system": "a", "one": 5, "two": 7, "total": 12}
    assert table["b"]["total"] == -1
    sizes = by_key(results.import_times_by_size(loads, ["a", "b"], 100), "category")
    assert sizes["large"]["a"] == 5.0 and sizes["small"]["a"] == 7.0 and sizes["small"]["b"] is None


def test_metric_file_and_append(spark, tmp_path):
    content = {"simple_x": {"times": [1.23456, 2.0], "memories": [1.0, 2.0], "output_lengths": [5, 0]}}
    (tmp_path / "metrics.json").write_text(json.dumps(content, indent=2))
    runs = results.read_metric_file(spark, str(tmp_path / "metrics.json"), "a")
    assert runs.count() == 2
    results.append_runs(runs, str(tmp_path / "runs"))
    results.append_runs(runs, str(tmp_path / "runs"))
    stored = spark.read.parquet(str(tmp_path / "runs")).collect()
    assert [(r.system, r.query, r.time, r.output_length) for r in stored] == [("a", "simple_x", 1.2346, 5)] * 2


def test_planned_runs(spark, runs):
    assert results.planned_runs(runs, runs).first().planned == 9


def test_run_suite(spark):
    authors = spark.createDataFrame([("t2_1", "x")], "author_fullname string, author string")
    posts = spark.createDataFrame([], "id string, name string, title string, author_fullname string, subreddit_id string, score bigint, num_comments bigint")
    tables = {"author": authors, "post": posts, "comment": posts, "wiki": posts.selectExpr("id AS path", "id AS content")}
    rows = run_suite(spark, SQL_SUITE, {"one": tables, "two": tables}, kinds=["simple"], skip=["simple_count_comments"], loops=2, seed=1).collect()
    assert sorted((r.system, r.query) for r in rows) == sorted(
        (s, q) for s in ("one", "two") for q in ("simple_select_authors", "simple_count_posts") for _ in range(2)
    )
    assert all(r.time > 0 and r.output_length == 1 for r in rows)


@pytest.mark.parametrize(
    "size, text",
    [(0, "0.00 bytes"), (1023, "1023.00 bytes"), (1024, "1.00 KB"), (41600, "40.62 KB"), (5 * 1024**3, "5.00 GB"), (1024**5, "1.00 PB"), (3 * 1024**6, "3.00 EB")],
)
def test_readable_size(spark, size, text):
    assert spark.range(1).select(S.readable_size(F.lit(size))).first()[0] == text


def test_display_time(spark):
    row = spark.sql("SELECT timestamp '2025-01-02 03:04:05' AS t").select(S.display_time(F.col("t"))).first()
    assert row[0] == "02 January 2025 03:04.05"


def test_rows_are_laid_out_before_they_become_documents(spark, monkeypatch):
    laid_out = []

    def layout(rows, keys):
        laid_out.append((rows.dtypes, keys))
        return with_key_layout(rows, keys)

    monkeypatch.setattr(standins, "_COLLECTIONS", {})
    monkeypatch.setattr(standins, "with_key_layout", layout)
    tables = "/root/testdata/sf0.001"
    rows = standins.posts(spark, tables)
    stored = standins.document_archive(spark, tables, ["post"])["post"]
    assert laid_out == [(rows.dtypes, ["id"])]
    assert sorted(map(str, stored.collect())) == sorted(map(str, rows.collect()))
