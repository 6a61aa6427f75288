import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import keys
from threadloom.operators.exploration import author_counts, column_groups, first_with_values, not_deleted, prefixed_columns
from threadloom.operators.lookups import array_lookup
from threadloom.plans.suite import DOCUMENT_SUITE, SQL_SUITE, document_table, high_average_subreddits_joined
from threadloom.sources.ndjson import PLACE, read_documents


def hot_rows(count=3000, seed=1):
    """Rows where one key holds a third of all rows."""
    pick = random.Random(seed)
    return [("hot" if pick.random() < 0.34 else f"k{pick.randrange(40)}", i, pick.randrange(9)) for i in range(count)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_first_seen_with_hot_key(spark, partitions):
    rows = hot_rows()
    expected = {}
    for key, place, value in rows:
        expected.setdefault(key, (place, value))
    df = spark.createDataFrame(rows, "k string, place bigint, v int").repartition(partitions)
    found = {r.k: (r.place, r.v) for r in keys.first_seen(df, ["k"], ["place"]).collect()}
    assert found == expected


def test_first_seen_limits_before_the_shuffle(spark):
    df = spark.createDataFrame(hot_rows(50), "k string, place bigint, v int")
    plan = keys.first_seen(df, ["k"], ["place"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_later_copies_and_duplicates(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, place bigint, v int")
    seen, later = set(), set()
    for key, place, _ in rows:
        if key in seen:
            later.add(place)
        seen.add(key)
    assert {r.place for r in keys.later_copies(df, ["k"], ["place"]).collect()} == later
    counts = {r.k: r.copies for r in keys.duplicate_keys(df, ["k"]).collect()}
    assert counts["hot"] == sum(1 for k, _, _ in rows if k == "hot")


def test_set_operators(spark):
    left = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id int")
    right = spark.createDataFrame([(2,), (3,)], "id int")
    assert {r.id for r in keys.difference(left, right).collect()} == {1, None}
    assert {(r.id, r.side) for r in keys.sets_differ(left, right).collect()} == {(1, "left"), (None, "left"), (3, "right")}
    assert keys.sets_differ(left, left).isEmpty()
    wide = spark.createDataFrame([(9, "x")], "id int, note string")
    assert sorted(keys.append_loads(wide, right).collect(), key=lambda r: r.id) == [(2, None), (3, None), (9, "x")]


def test_array_lookup_splits_hot_keys(spark):
    posts = spark.createDataFrame([("a",), ("hot",), ("none",)], "name string")
    comments = [("hot", f"h{i}", f"body {i}") for i in range(500)] + [("a", "a0", "only"), ("other", "o", "x")]
    right = spark.createDataFrame(comments, "link string, id string, body string")
    rows = array_lookup(posts, right, "name", "link", "body", "id", part_values=50).collect()
    hot = [r for r in rows if r.name == "hot"]
    assert len(hot) > 5 and all(r.matches == 500 for r in hot)
    assert sorted(b for r in hot for b in r["values"]) == sorted(f"body {i}" for i in range(500))
    assert max(len(r["values"]) for r in hot) < 100
    (a,) = [r for r in rows if r.name == "a"]
    (none,) = [r for r in rows if r.name == "none"]
    assert (a.matches, a["values"]) == (1, ["only"]) and (none.matches, none["values"]) == (0, [])


@pytest.fixture(scope="module")
def tables(spark):
    pick = random.Random(3)
    posts = []
    for i in range(120):
        # A missing author is the most frequent one; many scores tie.
        author = None if i % 3 == 0 else f"t2_{pick.randrange(9)}"
        posts.append((f"{i}", f"t3_{i}", f"title {i}", author, f"user {author}", f"t5_{i % 7}", pick.randrange(5) * 500, i % 11))
    comments = [
        (f"c{i}", f"t3_{pick.randrange(150)}", f"t3_{pick.randrange(150)}", f"t2_{i % 5}", f"body {i}") for i in range(400)
    ]
    return {
        "post": spark.createDataFrame(
            posts,
            "id string, name string, title string, author_fullname string, author string, subreddit_id string, score bigint, num_comments bigint",
        ),
        "comment": spark.createDataFrame(
            comments, "id string, link_id string, parent_id string, author_fullname string, body string"
        ),
        "author": spark.createDataFrame([(f"t2_{i}", f"name {i}") for i in range(7)], "author_fullname string, author string"),
        "subreddit": spark.createDataFrame([(f"t5_{i}", f"group {i}") for i in range(5)], "name string, display_name string"),
        "wiki": spark.createDataFrame([("/r/a", "text")], "path string, content string"),
    }


@pytest.mark.parametrize("name", list(SQL_SUITE))
def test_sql_form_equals_dataframe_form(spark, tables, name):
    query = SQL_SUITE[name]
    built = query.build(tables)
    written = query.from_sql(spark, tables)
    assert built.columns == written.columns
    assert sorted(map(repr, built.collect())) == sorted(map(repr, written.collect()))


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_suite_against_plain_python(tables):
    posts = [r.asDict() for r in tables["post"].collect()]
    comments = [r.asDict() for r in tables["comment"].collect()]
    ranked = sorted(posts, key=lambda p: (-p["score"], p["name"]))
    assert rows_of(SQL_SUITE["analytical_top_posts_by_score"].build(tables)) == [(p["title"], p["score"]) for p in ranked[:10]]

    top = {p["name"] for p in ranked[:50]}
    expected = sorted(c["author_fullname"] for c in comments if c["parent_id"] in top)
    assert sorted(r[0] for r in rows_of(SQL_SUITE["nested_top_commenters_on_top_post"].build(tables))) == expected

    expected = sorted(c["author_fullname"] for c in comments if c["link_id"] == ranked[0]["name"])
    assert sorted(r[0] for r in rows_of(DOCUMENT_SUITE["nested_top_commenters_on_top_post"].build(tables))) == expected

    counts = {}
    for p in posts:
        counts[p["author_fullname"]] = counts.get(p["author_fullname"], 0) + 1
    known = min((k for k in counts if k), key=lambda k: (-counts[k], k))
    by_known = sorted((p["id"], p["title"]) for p in posts if p["author_fullname"] == known)
    assert sorted(rows_of(SQL_SUITE["nested_posts_by_most_active_author"].build(tables))) == by_known
    unknown = sorted((p["id"], p["title"]) for p in posts if p["author_fullname"] is None)
    assert sorted(rows_of(DOCUMENT_SUITE["nested_posts_by_most_active_author"].build(tables))) == unknown

    groups = {}
    for p in posts:
        groups.setdefault(p["subreddit_id"], []).append(p["score"])
    high = {(g,) for g, s in groups.items() if sum(s) / len(s) > 1000}
    assert set(rows_of(SQL_SUITE["nested_subreddits_with_high_avg_score"].build(tables))) == high
    assert set(rows_of(high_average_subreddits_joined(tables))) == high
    assert set(rows_of(DOCUMENT_SUITE["nested_subreddits_with_high_avg_score"].build(tables))) == high


def test_lookup_array_is_the_inner_join_nested_again(tables):
    from threadloom.plans.suite import posts_with_comments

    nested = posts_with_comments(tables, posts=None)
    flat = nested.select("id", F.explode("comments").alias("body"))
    joined = tables["post"].join(tables["comment"].select("link_id", "body"), F.col("name") == F.col("link_id")).select("id", "body")
    assert sorted(rows_of(flat)) == sorted(rows_of(joined))
    assert nested.filter("num_comments = 0").count() > 0
    assert DOCUMENT_SUITE["join_posts_with_comments"].build(tables).count() == 5


def test_suite_plans(tables):
    def plan(query):
        return query.build(tables)._jdf.queryExecution().executedPlan().toString()

    assert "TakeOrderedAndProject" in plan(SQL_SUITE["analytical_top_posts_by_score"])
    assert "BroadcastHashJoin" in plan(SQL_SUITE["nested_top_commenters_on_top_post"])
    for query in [*SQL_SUITE.values(), *DOCUMENT_SUITE.values()]:
        text = plan(query)
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text and "Python" not in text


def test_document_table(spark):
    lines = spark.createDataFrame([('{"id": "a", "score": 5, "x": [1]}',), ('{"id": "b", "score": "?"}',)], "value string")
    table = document_table(read_documents(lines, ["id"]), "id string, score bigint")
    assert rows_of(table) == [("a", 5), ("b", None)]


def test_exploration(spark):
    df = spark.createDataFrame(
        [("1", "a", "[]", 1), ("2", "[deleted]", '["x"]', 2), ("3", "a", None, 3), ("4", None, "[]", 4)],
        "id string, author string, awarders string, score int",
    )
    assert rows_of(author_counts(df)) == [(1, 1)]
    assert not_deleted(df).count() == 2
    assert prefixed_columns(df, "a", always=["id"]).columns == ["id", "author", "awarders"]
    groups = column_groups(df)
    assert groups["author_keys"].columns == ["id", "author"]
    assert [r.awarders for r in groups["awards_flair_keys"].orderBy("id").collect()] == [None, '["x"]', None, None]
    arrays = df.withColumn("awards", F.from_json("awarders", "array<string>"))
    assert [r.id for r in first_with_values(arrays, F.col("awards"), ["id"]).collect()] == ["2"]


def test_marked_rows_are_exact_and_small(spark):
    numbers = [0, 1, 5, 32767, 32768, 32769, 65536, (1 << 33), (1 << 33) + 32768]
    rows = spark.createDataFrame([(f, b, n) for f in ("x", "y") for b in (0, 64) for n in numbers], "file_path string, block_start bigint, row_id bigint")
    chosen = rows.filter("(row_id % 32768 < 2 and file_path = 'x') or row_id = 5 and block_start = 64")
    found = keys.with_mark(rows, keys.marked_rows(chosen, PLACE), PLACE, "copy")
    assert found.columns == [*rows.columns, "copy"] and found.count() == rows.count()
    assert sorted(found.filter("copy").drop("copy").collect()) == sorted(chosen.collect())
    # So many places are joined without a shuffle of the rows that meet them, though as rows they would be beyond the bound.
    many = spark.range(200_000).select(F.lit("x").alias("file_path"), F.lit(0).cast("bigint").alias("block_start"), F.col("id").alias("row_id"))
    assert keys.marked_rows(many, PLACE).count() <= 8
