import json
from dataclasses import replace

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from threadloom.catalog import DEFAULT_CATALOG, Catalog, Source
from threadloom.operators import key_filter
from threadloom.operators.cleaners import default_cleaners
from threadloom.plans import load
from threadloom.sinks import commits as log

TABLES = DEFAULT_CATALOG.sources["submissions"].tables


def post(name, **more):
    return {"id": name, "name": f"t3_{name}", "author": f"user {name}", "author_fullname": f"t2_{name}", "score": 1, "edited": False, "distinguished": "admin", **more}


def ids(spark, store, table="post", version=None):
    return sorted(r[0] for r in load.read_loaded(spark, store, table, version=version).select(DEFAULT_CATALOG.key(table)[0]).collect())


def killed_at(table):
    registry = default_cleaners()
    registry.register(table, lambda rows: rows.filter(F.when(F.rand(1) >= 0, F.raise_error(F.lit("killed"))).isNull()))
    return registry


@pytest.mark.parametrize("table", TABLES)
def test_killed_load_shows_nothing(spark, dump, tmp_path, table):
    store = load.Store(str(tmp_path / "store"))
    load.load_source(spark, "submissions", dump("one", [post("a")]), store)
    two = dump("two", [post("b"), "broken"])
    with pytest.raises(PySparkException):
        load.load_source(spark, "submissions", two, store, killed_at(table), on_duplicate="keep")
    for t in TABLES:
        assert len(ids(spark, store, t)) == 1
    assert load.ledger(spark, store).count() == 3 and load.summary(spark, store).count() == 1
    assert load.load_source(spark, "submissions", two, store) == list(TABLES)
    for t in TABLES:
        assert len(ids(spark, store, t)) == 2 and len(ids(spark, store, t, version=1)) == 1
    assert [r.fault for r in load.read_quarantine(spark, store).collect()] == ["malformed_json"]


def test_tables_of_a_dump_loaded_one_after_the_other_keep_their_quarantine(spark, dump, tmp_path):
    store = load.Store(str(tmp_path / "store"))
    path = dump("RS", [post("a", score="x"), post("b", author_fullname=None), "broken", post("c")])
    posts = replace(DEFAULT_CATALOG, sources={"submissions": replace(DEFAULT_CATALOG.sources["submissions"], tables=("post",))})
    assert load.load_source(spark, "submissions", path, store, catalog=posts) == ["post"]
    before = {(r.table, r.fault) for r in load.read_quarantine(spark, store).collect()}
    assert before == {("submissions", "malformed_json"), ("post", "bad_value:score")}
    assert load.load_source(spark, "submissions", path, store) == ["author", "distinguished_post"]
    after = sorted((r.table, r.fault) for r in load.read_quarantine(spark, store).collect())
    assert after == sorted([*before, ("author", "key_missing")])


def test_unfinished_commits_do_not_count(spark, dump, tmp_path):
    store = load.Store(str(tmp_path / "store"))
    load.load_source(spark, "submissions", dump("one", [post("a")]), store)
    (tmp_path / "store" / "commits" / f"{2:020d}.json").write_text("")
    (tmp_path / "store" / "commits" / f"{3:020d}.json").write_text('{"version": 3, "load_id"')
    assert ids(spark, store) == ["t3_a"]
    load.load_source(spark, "submissions", dump("two", [post("b")]), store)
    assert ids(spark, store) == ["t3_a", "t3_b"] and log.last_version(spark, store.commits) == 4


def test_two_loads_at_a_time(spark, tmp_path):
    path = str(tmp_path / "commits")

    def commit(load_id, *tables):
        return log.Commit(load_id, "spark", "file", 0.0, parts=[log.Part(t, f"load_id={load_id}") for t in tables])

    assert log.publish(spark, path, commit("one", "post"), 0) == 1
    assert log.publish(spark, path, commit("two", "comment"), 0) == 2
    with pytest.raises(log.CommitConflict):
        log.publish(spark, path, commit("three", "wiki", "post"), 0)
    assert log.publish(spark, path, commit("three", "wiki", "post"), 2) == 3
    assert log.last_version(spark, path) == 3
    assert log.published_parts(spark, path).count() == 4 and log.published_parts(spark, path, 1).count() == 1


def test_sweep_removes_what_no_commit_names(spark, dump, tmp_path):
    store = load.Store(str(tmp_path / "store"))
    path = dump("RS", [post(n) for n in "abc"])
    load.load_source(spark, "submissions", path, store, max_lines=2)
    with pytest.raises(PySparkException):
        load.load_source(spark, "submissions", path, store, killed_at("distinguished_post"), on_duplicate="keep")
    load.load_source(spark, "submissions", path, store)
    assert load.sweep(spark, store) == []
    # The capped load: three tables and their key filters. The killed one: two tables.
    assert len(load.sweep(spark, store, min_age_seconds=0)) >= 6
    assert load.sweep(spark, store, min_age_seconds=0) == []
    assert ids(spark, store) == ["t3_a", "t3_b", "t3_c"]
    again = dump("later", [post("c"), post("d")])
    load.load_source(spark, "submissions", again, store, on_duplicate="quarantine")
    assert ids(spark, store) == ["t3_a", "t3_b", "t3_c", "t3_d"]


def test_own_catalogue_with_first_seen_and_composite_keys(spark, dump, tmp_path):
    catalog = Catalog(
        columns={"member": "id string, name string", "visit": "id string, day string, n bigint"},
        keys={"member": ("id",), "visit": ("id", "day")},
        sources={"visits": Source("visits", ("member", "visit"), "visit")},
        first_seen=frozenset({"member"}),
        computed_keys={},
    )
    store = load.Store(str(tmp_path / "store"))
    rows = [{"id": "a", "name": "Ann", "day": "1", "n": 1}, {"id": "a", "name": "Anna", "day": "2", "n": 1}, {"id": "b", "name": "Bob", "day": "1", "n": 1}]
    load.load_source(spark, "visits", dump("one", rows), store, catalog=catalog)
    more = [{"id": "a", "name": "Annie", "day": "3", "n": 1}, {"id": "a", "name": "A", "day": "1", "n": 9}, {"id": "c", "name": "Cy", "day": "1", "n": 1}]
    load.load_source(spark, "visits", dump("two", more), store, catalog=catalog, on_duplicate="quarantine")
    assert sorted(map(tuple, load.read_loaded(spark, store, "member", catalog).collect())) == [("a", "Ann"), ("b", "Bob"), ("c", "Cy")]
    visits = sorted((r.id, r.day, r.n) for r in load.read_loaded(spark, store, "visit", catalog).collect())
    assert visits == [("a", "1", 1), ("a", "2", 1), ("a", "3", 1), ("b", "1", 1), ("c", "1", 1)]
    (aside,) = load.read_quarantine(spark, store).collect()
    assert aside.fault == "key_repeated" and json.loads(aside.value)["n"] == "9"


def test_key_filters_never_miss_and_seldom_pass(spark):
    stored = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    size = key_filter.filter_size(3000)
    filters = key_filter.key_filter(stored, "post", size).withColumn("part", F.lit("p"))
    new = spark.range(2000, 12_000).select(F.concat(F.lit("k"), "id").alias("key"))
    hits = {r.key for r in key_filter.possible_hits(new, filters, [("p", size)]).collect()}
    assert {f"k{i}" for i in range(2000, 3000)} <= hits
    assert len(hits) < 1000 + 9000 // 8
    assert key_filter.possible_hits(new, filters, [("another", size)]).count() == 0


def test_a_fresh_load_takes_few_jobs(spark, dump, tmp_path):
    store = load.Store(str(tmp_path / "store"))
    path = dump("RS", [post(str(i)) for i in range(300)])
    context = spark.sparkContext
    context.setJobGroup("fresh-load", "jobs of one load")
    try:
        load.load_source(spark, "submissions", path, store)
        jobs = context.statusTracker().getJobIdsForGroup("fresh-load")
    finally:
        context._jsc.clearJobGroup()
    assert len(jobs) <= 30
    print(len(jobs))
