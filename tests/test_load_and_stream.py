import os

import pytest
from pyspark.sql import functions as F

from threadloom.catalog import Catalog, Source
from threadloom.operators.cleaners import default_cleaners
from threadloom.plans import load
from threadloom.registered import QUERIES
from threadloom.session import checkpoint_root, drop_scratch
from threadloom.sinks import tables as sinks
from threadloom.sources.lists import default_ignore_list
from threadloom.sources.ndjson import read_lines
from threadloom.sources.tables import list_tables, read_sql, register_views
from threadloom.streaming.loader import stream_any_per_key, stream_lines, stream_source


def post(name, author, fullname, **more):
    return {"id": name, "name": f"t3_{name}", "author": author, "author_fullname": fullname, "score": 1, "edited": False, **more}


MONTH_ONE = [
    post("a", "ann", "t2_1", author_premium=True),
    post("b", "bob", "t2_2"),
    "broken {",
    "",
    post("c", "Ann renamed", "t2_1", distinguished="moderator"),
    {"id": "n", "name": None, "score": 1, "edited": False},
    post("d", "AutoModerator", "t2_9"),
]
MONTH_TWO = [post("e", "bob later", "t2_2"), post("f", "cid", "t2_3"), post("g", "cid again", "t2_3", score="12")]


def read(spark, store, table):
    return load.read_loaded(spark, store, table)


def authors(spark, store):
    return sorted((r.author_fullname, r.author) for r in read(spark, store, "author").collect())


FIRST_AUTHORS = [("t2_1", "ann"), ("t2_2", "bob"), ("t2_3", "cid")]


def test_batch_load(spark, dump, tmp_path):
    store = load.Store(str(tmp_path / "store"))
    one, two = dump("RS_1", MONTH_ONE), dump("RS_2", MONTH_TWO)
    registry = default_cleaners(default_ignore_list(spark))
    assert load.load_source(spark, "submissions", one, store, registry) == ["post", "author", "distinguished_post"]
    assert load.load_source(spark, "submissions", one, store, registry) == []
    assert load.load_source(spark, "submissions", two, store, registry) == ["post", "author", "distinguished_post"]
    assert sorted(r.id for r in read(spark, store, "post").collect()) == list("abcdefg")
    assert authors(spark, store) == FIRST_AUTHORS
    assert [r.id for r in read(spark, store, "distinguished_post").collect()] == ["c"]

    reasons = {(r.table, r.fault) for r in load.read_quarantine(spark, store).collect()}
    assert reasons == {("submissions", "malformed_json"), ("post", "key_missing"), ("author", "key_missing")}
    entries = load.ledger_entries(load.ledger(spark, store)).collect()
    assert {r.file: r.success_tables for r in entries} == {f: ["author", "distinguished_post", "post"] for f in (one, two)}
    summary = {r.data_file: r for r in load.summary(spark, store).collect()}
    assert summary[one].line_count == 7 and summary[two].line_count == 3 and summary[one].writes == 3
    assert summary[one].time_elapsed_seconds == summary[one].end_time - summary[one].start_time


def test_staging_copy_is_removed(spark, dump, tmp_path):
    root = checkpoint_root(spark).removeprefix("file:")

    def staged():
        return {f for f in os.listdir(root) if f.startswith("staged-")}

    before = staged()
    load.load_source(spark, "subreddits_meta_only", dump("meta", [{"display_name": "s", "num_posts": 3}]), load.Store(str(tmp_path)))
    assert staged() == before
    drop_scratch(spark, str(tmp_path / "tables"))
    assert (tmp_path / "tables").exists()


def test_row_cap_counts_bad_lines(spark, dump, tmp_path):
    store = load.Store(str(tmp_path / "store"))
    load.load_source(spark, "submissions", dump("RS", MONTH_ONE), store, max_lines=4)
    assert sorted(r.id for r in read(spark, store, "post").collect()) == ["a", "b"]


def test_full_load_after_a_capped_one(spark, dump, tmp_path):
    store, path = load.Store(str(tmp_path / "store")), dump("RS", MONTH_ONE)
    load.load_source(spark, "submissions", path, store, max_lines=2)
    assert sorted(r.id for r in read(spark, store, "post").collect()) == ["a", "b"]
    assert load.load_source(spark, "submissions", path, store) == ["post", "author", "distinguished_post"]
    assert sorted(r.id for r in read(spark, store, "post").collect()) == ["a", "b", "c", "d"]
    assert load.load_source(spark, "submissions", path, store) == []


def test_broken_rules_are_kept_in_quarantine(spark, dump, tmp_path):
    store = load.Store(str(tmp_path / "store"))
    lines = [
        {"subreddit": "a", "rules": [{"short_name": "Be kind", "priority": 1}]}, {"subreddit": "b", "rules": "none"},
        {"subreddit": "", "rules": [{}]}, "broken {", {"subreddit": "c", "rules": None},
    ]
    load.load_source(spark, "subreddit_rules", dump("rules", lines), store)
    kept = load.read_quarantine(spark, store).collect()
    assert {(r.kind, r.fault) for r in kept} == {("lines:subreddit_rules", "malformed_json"), ("subreddit_rules", "bad_rules"), ("subreddit_rules", "key_missing")}
    assert [r.subreddit for r in read(spark, store, "subreddit_rules").collect()] == ["a"]


def test_staging_copy_is_removed_after_a_failure(spark, dump, tmp_path):
    root = checkpoint_root(spark).removeprefix("file:")
    before = {f for f in os.listdir(root) if f.startswith("staged-")}
    path = dump("RS", [post("a", "x", "t2_1"), post("a", "y", "t2_1")])
    with pytest.raises(load.DuplicateKeyError):
        load.load_source(spark, "submissions", path, load.Store(str(tmp_path / "s")))
    assert {f for f in os.listdir(root) if f.startswith("staged-")} == before


def test_two_streams_into_one_store(spark, dump, tmp_path):
    store = load.Store(str(tmp_path / "store"))
    for n, lines in enumerate((MONTH_ONE, MONTH_TWO)):
        dump("RS", lines, folder=f"in{n}")
        stream = stream_lines(spark, str(tmp_path / f"in{n}"))
        registry = default_cleaners(default_ignore_list(spark))
        stream_source(stream, "submissions", store, str(tmp_path / f"checkpoint{n}"), registry=registry).awaitTermination()
    assert sorted(r.id for r in read(spark, store, "post").collect()) == list("abcdefg")
    assert authors(spark, store) == FIRST_AUTHORS
    assert sorted(r.line_count for r in load.summary(spark, store).collect()) == [3, 7]


def test_failed_load_can_be_repeated(spark, dump, tmp_path):
    store = load.Store(str(tmp_path / "store"))
    path = dump("RS", MONTH_TWO)
    load.load_source(spark, "submissions", path, store)
    os.rename(store.commits, str(tmp_path / "lost-commits"))
    load.load_source(spark, "submissions", path, store)
    assert sorted(r.id for r in read(spark, store, "post").collect()) == ["e", "f", "g"]
    assert authors(spark, store) == [("t2_2", "bob later"), ("t2_3", "cid")]


def test_repeated_key(spark, dump, tmp_path):
    lines = [post("a", "x", "t2_1", title="first"), post("a", "x", "t2_1", title="second"), post("b", "y", "t2_2")]
    path = dump("RS", lines)
    strict = load.Store(str(tmp_path / "strict"))
    with pytest.raises(load.DuplicateKeyError):
        load.load_source(spark, "submissions", path, strict)
    assert [r.fault for r in load.read_quarantine(spark, strict).filter("table = 'post'").collect()] == ["key_repeated"]

    lenient = load.Store(str(tmp_path / "lenient"))
    load.load_source(spark, "submissions", path, lenient, on_duplicate="quarantine")
    again = dump("RS_again", [post("b", "z", "t2_3", title="known"), post("c", "z", "t2_3")])
    load.load_source(spark, "submissions", again, lenient, on_duplicate="quarantine")
    stored = read(spark, lenient, "post").orderBy("id").collect()
    assert [(r.id, r.title) for r in stored] == [("a", "first"), ("b", None), ("c", None)]
    kept = load.read_quarantine(spark, lenient).filter("fault = 'key_repeated'").collect()
    assert len(kept) == 2 and any('"title":"second"' in r.value for r in kept)


def test_wiki_and_rules_load(spark, dump, tmp_path):
    store = load.Store(str(tmp_path / "store"))
    wiki = [
        {"path": "/r/s/a", "content": "x", "revision_date": "2025-01-01T00:00:00Z", "revision_author": "u"},
        {"path": "/r/s/b", "content": "x", "revision_date": "?", "revision_author": "u"},
    ]
    load.load_source(spark, "subreddit_wikis", dump("wikis", wiki), store)
    assert [r.path for r in read(spark, store, "wiki").collect()] == ["/r/s/a"]
    assert read(spark, store, "revision_wiki").count() == 2
    assert load.read_quarantine(spark, store).filter("fault = 'bad_date'").count() == 1
    rules = [{"subreddit": "s", "rules": [{"priority": i, "short_name": "n", "description": "d"} for i in range(3)]}]
    load.load_source(spark, "subreddit_rules", dump("rules", rules), store)
    assert read(spark, store, "subreddit_rules").count() == 3


def test_document_load(spark, dump, tmp_path):
    store = load.Store(str(tmp_path / "store"))
    path = dump("RS", MONTH_ONE)
    assert load.load_documents(spark, "submissions", path, store)
    assert not load.load_documents(spark, "submissions", path, store)
    stored = load.read_collection(spark, store, "post")
    names = stored.select(F.expr("variant_get(doc, '$.author', 'string')").alias("a")).collect()
    assert len(names) == 5 and {"ann", "bob"} <= {r.a for r in names}


def test_ledger_helpers(spark):
    entries = spark.createDataFrame(
        [("f", ["post"], ["post", "author"]), ("g", ["author"], ["author"]), ("h", ["post"], None)],
        "file string, success_tables array<string>, duplicates_removed array<string>",
    )
    cleaned = {r.file: r.duplicates_removed for r in load.clean_ledger(entries).collect()}
    assert cleaned == {"f": ["post"], "g": ["author"], "h": None}
    assert sorted(r.table for r in load.deduplicated_tables(load.clean_ledger(entries)).collect()) == ["author", "post"]


def write_aged(dump, name, lines, age):
    path = dump(name, lines, "incoming")
    os.utime(path, (1_700_000_000 + age, 1_700_000_000 + age))
    return path


@pytest.mark.parametrize("files_per_batch", [1, 10])
def test_stream_equals_batch(spark, dump, tmp_path, files_per_batch):
    store = load.Store(str(tmp_path / "store"))
    registry = default_cleaners(default_ignore_list(spark))
    folder = os.path.dirname(write_aged(dump, "z_older", MONTH_ONE, 0))
    state = str(tmp_path / "state")

    def run():
        lines = stream_lines(spark, folder, files_per_batch)
        stream_source(lines, "submissions", store, state, registry=registry).awaitTermination()

    run()
    write_aged(dump, "a_newer", MONTH_TWO, 50)
    run()
    run()
    assert sorted(r.id for r in read(spark, store, "post").collect()) == list("abcdefg")
    assert authors(spark, store) == FIRST_AUTHORS


def test_stream_arrival_order_inside_a_batch(spark, dump, tmp_path):
    store = load.Store(str(tmp_path / "store"))
    write_aged(dump, "z_older", MONTH_ONE, 0)
    folder = os.path.dirname(write_aged(dump, "a_newer", MONTH_TWO, 50))
    query = stream_source(
        stream_lines(spark, folder), "submissions", store, str(tmp_path / "state"), registry=default_cleaners(default_ignore_list(spark))
    )
    query.awaitTermination()
    assert authors(spark, store) == FIRST_AUTHORS


def test_stream_any_per_key(spark, dump, tmp_path):
    folder = os.path.dirname(dump("x", ["a", "b", "a"], "incoming"))
    out = str(tmp_path / "out")
    for _ in range(2):
        lines = stream_lines(spark, folder, 1).select("value")
        stream_any_per_key(lines, ["value"], out, str(tmp_path / "state")).awaitTermination()
        dump("y", ["b", "c"], "incoming")
    assert sorted(r.value for r in spark.read.schema("value string").parquet(out).collect()) == ["a", "b", "c"]


def test_catalogue_tables(spark):
    small = Catalog(
        columns={"loom_one": "a string, b bigint", "loom_two": "a string, c boolean"},
        keys={"loom_one": ("a",), "loom_two": ("a", "c")},
        sources={"s": Source("s", ("loom_one", "loom_two"), "loom_one")},
    )
    assert sinks.create_tables(spark, small) == ["loom_one", "loom_two"]
    assert sinks.create_tables(spark, small) == []
    assert {"loom_one", "loom_two"} <= set(list_tables(spark))
    done = spark.createDataFrame([("loom_one",)], "t string")
    assert sinks.drop_unfinished(spark, ["loom_one", "loom_two", "absent"], done, overwrite=False) == ["loom_two"]
    assert sinks.drop_unfinished(spark, ["loom_one", "loom_two"], done, overwrite=True) == []
    assert "loom_two" not in list_tables(spark)
    spark.sql("DROP TABLE loom_one")


def test_bucketed_join_has_no_shuffle(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(200).select(F.concat(F.lit("t3_"), "id").alias("name"), "id")
        sinks.write_bucketed(rows, "loom_left", "name", 4)
        sinks.write_bucketed(rows, "loom_right", "name", 4)
        joined = spark.table("loom_left").join(spark.table("loom_right"), "name")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE IF EXISTS loom_left")
        spark.sql("DROP TABLE IF EXISTS loom_right")


def test_key_layout_lets_a_lookup_skip_files(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_table(sinks.with_key_layout(spark.range(1000).selectExpr("id AS k"), ["k"], files=4), path)
    files = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    ranges = sorted((r.lo, r.hi) for r in files.collect())
    assert len(ranges) == 4 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_views_and_sql(spark):
    register_views({"loom_view": spark.range(3)})
    assert "loom_view" in list_tables(spark)
    assert read_sql(spark, "SELECT sum(id) AS s FROM loom_view").first().s == 3
    assert read_sql(spark, "SELECT max(id) AS m FROM {t}", t=spark.range(5)).first().m == 4
    spark.catalog.dropTempView("loom_view")


def test_read_lines_orders_by_place(spark, dump):
    path = dump("o", [str(i) for i in range(100)])
    rows = read_lines(spark, path).orderBy("file_path", "block_start", "row_id").collect()
    assert [r.value for r in rows] == [str(i) for i in range(100)]


def test_archive_of_pages_that_share_addresses(spark, tmp_path):
    tables = "/root/testdata/sf0.001"
    pages, documents = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("pages", "documents"))
    twice = pages.unionByName(pages.withColumn("page_id", F.col("page_id") + pages.count()))
    twice.write.parquet(str(tmp_path / "pages.parquet"))
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    counts = {r.table: r.n for r in QUERIES["load_archive"](spark, str(tmp_path)).collect()}
    good = twice.filter(F.contains("url", F.lit("/en/")) & ~F.contains("url", F.lit("ref=")))
    rules = documents.select(F.explode(F.split("text", "\n", -1)))
    assert counts == {"wiki": good.count(), "revision_wiki": twice.count(), "subreddit_rules": rules.count()}
