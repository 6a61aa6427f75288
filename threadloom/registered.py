"""Registered queries: every operator over the driver tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import standins as T
from threadloom.catalog import DEFAULT_CATALOG, Catalog, Source
from threadloom.functions import nested, scalars
from threadloom.operators import cleaners, exploration, keys, manifest, profile
from threadloom.operators.lookups import array_lookup
from threadloom.operators.skew import salted_join
from threadloom.plans import load, results
from threadloom.plans.runner import run_suite
from threadloom.plans.suite import DOCUMENT_SUITE, SQL_SUITE, document_table, high_average_subreddits_joined, posts_with_comments
from threadloom.session import scratch_path, tune
from threadloom.sinks import json_files, tables as sinks
from threadloom.sources import byte_ranges, lists, ndjson, numbering
from threadloom.sources.line_index import LineIndex, first_lines_of
from threadloom.sources.tables import list_tables, read_sql, register_views
from threadloom.streaming.loader import latest_revisions, stream_any_per_key, stream_first_arrivals, stream_lines, stream_source

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def registered(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(build: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: build(tune(spark), sf_dir)
        if sql is not None:
            ORACLE[name] = sql
        return build

    return add


# ---------------------------------------------------------------- query suite

ARCHIVE_SQL = """
post AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, 't3_' || o_orderkey AS name,
                o_orderpriority || ' ' || o_orderkey AS title,
                CASE WHEN o_orderstatus <> 'P' THEN 't2_' || o_custkey END AS author_fullname,
                'user_' || o_custkey AS author, 't5_' || o_custkey AS subreddit_id,
                CAST(floor(o_totalprice / 300) AS BIGINT) AS score,
                CAST(floor(o_totalprice / 10000) AS BIGINT) AS num_comments
         FROM orders),
author AS (SELECT CASE WHEN c_acctbal >= 0 THEN 't2_' ELSE 'x2_' END || c_custkey AS author_fullname, c_name AS author FROM customer),
subreddit AS (SELECT CASE WHEN c_mktsegment <> 'MACHINERY' THEN 't5_' ELSE 'x5_' END || c_custkey AS name,
                     c_mktsegment || '_' || c_custkey AS display_name FROM customer),
comment AS (SELECT l_orderkey || '_' || l_partkey || '_' || l_linenumber AS id, 't3_' || l_orderkey AS link_id,
                   CASE WHEN l_linenumber = 1 THEN 't3_' ELSE 't1_' END || l_orderkey AS parent_id,
                   't2_' || l_suppkey AS author_fullname, l_returnflag || l_linestatus || l_partkey AS body
            FROM lineitem),
wiki AS (SELECT url AS path, html AS content FROM pages)
"""


def _archive_sql(body: str) -> str:
    return f"WITH {ARCHIVE_SQL} {body}"


SUITE_ORACLE = {
    "simple_select_authors": "SELECT author_fullname, author FROM author",
    "simple_count_posts": "SELECT count(*) AS post_count FROM post",
    "simple_count_comments": "SELECT count(*) AS comment_count FROM comment",
    "simple_unique_subreddits": "SELECT DISTINCT subreddit_id FROM post",
    "select_path_content_from_wiki": "SELECT path, content FROM wiki",
    "join_posts_with_authors": (
        "SELECT p.id, p.title, a.author FROM post p JOIN author a ON p.author_fullname = a.author_fullname"
    ),
    "join_posts_with_subreddits": (
        "SELECT p.id, p.title, s.display_name FROM post p JOIN subreddit s ON p.subreddit_id = s.name"
    ),
    "join_comments_with_posts": (
        "SELECT c.id AS comment_id, p.title AS post_title FROM comment c JOIN post p ON c.parent_id = p.name"
    ),
    "analytical_top_posts_by_score": "SELECT title, score FROM post ORDER BY score DESC, name LIMIT 10",
    "analytical_average_comments_per_post": "SELECT round(avg(num_comments), 6) AS avg_comments FROM post",
    "analytical_active_subreddits_by_post_count": (
        "SELECT subreddit_id, count(*) AS post_count FROM post GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"
    ),
    "nested_top_commenters_on_top_post": (
        "SELECT c.author_fullname FROM comment c JOIN (SELECT name FROM post ORDER BY score DESC, name LIMIT 50) t "
        "ON c.parent_id = t.name"
    ),
    "nested_posts_by_most_active_author": (
        "SELECT id, title FROM post WHERE author_fullname = (SELECT author_fullname FROM post "
        "WHERE author_fullname IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
    ),
    "nested_subreddits_with_high_avg_score": (
        "SELECT DISTINCT p.subreddit_id FROM post p JOIN (SELECT subreddit_id FROM post GROUP BY 1 "
        "HAVING avg(score) > 1000 ORDER BY avg(score) DESC, 1 LIMIT 100) h ON p.subreddit_id = h.subreddit_id"
    ),
}

DOCUMENT_ORACLE = SUITE_ORACLE | {
    "simple_select_authors": "SELECT coalesce(author_fullname, '-') AS author_fullname, author FROM post",
    "join_posts_with_comments": (
        "SELECT p.id, p.title, count(c.id) AS num_comments, "
        "coalesce(string_agg(c.body, '|' ORDER BY c.body), '') AS comments "
        "FROM (SELECT * FROM post ORDER BY name LIMIT 5) p LEFT JOIN comment c ON c.link_id = p.name GROUP BY 1, 2"
    ),
    "nested_top_commenters_on_top_post": (
        "SELECT author_fullname FROM comment WHERE link_id = (SELECT name FROM post ORDER BY score DESC, name LIMIT 1)"
    ),
    "nested_posts_by_most_active_author": (
        "SELECT id, title FROM post WHERE author_fullname IS NOT DISTINCT FROM (SELECT author_fullname FROM post "
        "GROUP BY 1 ORDER BY count(*) DESC, 1 NULLS LAST LIMIT 1)"
    ),
    "nested_subreddits_with_high_avg_score": "SELECT subreddit_id FROM post GROUP BY 1 HAVING avg(score) > 1000",
}


def _comparable(df: DataFrame) -> DataFrame:
    """Averages rounded and comment arrays as sorted text, so two engines can be compared."""
    if "author_fullname" in df.columns:
        df = df.fillna("-", "author_fullname")
    if "avg_comments" in df.columns:
        df = df.withColumn("avg_comments", F.round("avg_comments", 6))
    if "comments" in df.columns:
        df = df.withColumn("comments", F.array_join(F.array_sort("comments"), "|")).drop("part")
    return df


def _register_suite() -> None:
    for name, query in SQL_SUITE.items():
        registered(name, _archive_sql(SUITE_ORACLE[name]))(
            lambda spark, sf_dir, q=query: _comparable(q.build(T.archive(spark, sf_dir, q.inputs)))
        )
        registered(f"{name}_sql", _archive_sql(SUITE_ORACLE[name]))(
            lambda spark, sf_dir, q=query: _comparable(q.from_sql(spark, T.archive(spark, sf_dir, q.inputs)))
        )
    for name, query in DOCUMENT_SUITE.items():
        registered(f"{name}_document", _archive_sql(DOCUMENT_ORACLE[name]))(
            lambda spark, sf_dir, q=query: _comparable(q.build(T.document_archive(spark, sf_dir, q.inputs)))
        )


_register_suite()


@registered(
    "nested_subreddits_with_high_avg_score_joined",
    _archive_sql(SUITE_ORACLE["nested_subreddits_with_high_avg_score"]),
)
def _(spark, sf_dir):
    return high_average_subreddits_joined(T.archive(spark, sf_dir))


@registered(
    "lookup_array_all_posts",
    _archive_sql(
        "SELECT p.id, p.title, count(c.id) AS num_comments, "
        "coalesce(string_agg(c.body, '|' ORDER BY c.body), '') AS comments "
        "FROM post p LEFT JOIN comment c ON c.link_id = p.name GROUP BY 1, 2"
    ),
)
def _(spark, sf_dir):
    return _comparable(posts_with_comments(T.archive(spark, sf_dir), posts=None))


@registered(
    "lookup_array_parts",
    _archive_sql("SELECT p.id, c.body FROM post p JOIN comment c ON c.link_id = p.name"),
)
def _(spark, sf_dir):
    """One row for each match: however small the parts, every match is in one of them."""
    tables = T.archive(spark, sf_dir, ("post", "comment"))
    parts = array_lookup(tables["post"].select("id", "name"), tables["comment"], "name", "link_id", value="body", row_key="id", part_values=2)
    return parts.select("id", F.explode("values").alias("body"))


HOT_LINK = "CASE WHEN l_linenumber <= 2 THEN 't3_' || (SELECT min(o_orderkey) FROM orders) ELSE 't3_' || l_orderkey END"


@registered(
    "join_hot_post",
    f"""SELECT l_orderkey, l_linenumber, 't3_' || o_orderkey AS name, o_orderstatus AS status FROM
          (SELECT *, {HOT_LINK} AS link FROM lineitem) JOIN orders ON link = 't3_' || o_orderkey""",
)
def _(spark, sf_dir):
    """Comments of which over a third stand below one post, joined with their posts: the hot key is found and spread."""
    orders = T.table(spark, sf_dir, "orders")
    first = F.concat(F.lit("t3_"), F.lit(str(orders.agg(F.min("o_orderkey")).first()[0])))
    link = F.when(F.col("l_linenumber") <= 2, first).otherwise(F.concat(F.lit("t3_"), F.col("l_orderkey").cast("string")))
    items = T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", link.alias("link"))
    named = orders.select(F.concat(F.lit("t3_"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderstatus").alias("status"))
    return salted_join(items, named, "link", "name", share=0.01).drop("link")


@registered("sql_table_read", _archive_sql("SELECT subreddit_id, max(score) AS best FROM post GROUP BY 1"))
def _(spark, sf_dir):
    register_views({"post": T.posts(spark, sf_dir)})
    return read_sql(spark, "SELECT subreddit_id, max(score) AS best FROM post GROUP BY subreddit_id")


# ---------------------------------------------------------------- cleaners


def _parsed(lines: DataFrame, source: str, *tables: str) -> DataFrame:
    return ndjson.parse_records(lines, DEFAULT_CATALOG.raw_fields(source, tables or None))


def _cleaned(lines: DataFrame, source: str, table: str, registry=None) -> DataFrame:
    sound = _parsed(lines, source, table).filter(F.col("fault").isNull())
    rows = cleaners.clean_table(sound, table, registry or cleaners.default_cleaners())
    return cleaners.project(rows, table, extra=["row_id"])


@registered(
    "normalise_post",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, 't3_' || o_orderkey AS name,
              o_orderpriority || ' ' || o_orderkey AS title, CAST(floor(o_totalprice / 300) AS BIGINT) AS score,
              CAST(floor(epoch(o_orderdate)) AS BIGINT) AS created_utc,
              '["' || o_orderpriority || '"]' AS content_categories
       FROM orders""",
)
def normalise_post(spark, sf_dir):
    posts = _cleaned(T.submission_lines(spark, sf_dir), "submissions", "post")
    return posts.select("id", "name", "title", "score", "created_utc", "content_categories")


POST_COLUMNS = [c.split()[0] for c in DEFAULT_CATALOG.columns["post"].split(", ")]

# What the raw post records hold, by column of the table; all other columns are NULL.
POST_VALUES_SQL = {
    "id": "CAST(o_orderkey AS VARCHAR)", "name": "'t3_' || o_orderkey", "title": "o_orderpriority || ' ' || o_orderkey",
    "author_fullname": "CASE WHEN o_orderstatus <> 'P' THEN 't2_' || o_custkey END", "score": "CAST(CAST(floor(o_totalprice / 300) AS BIGINT) AS VARCHAR)",
    "created_utc": "CAST(CAST(floor(epoch(o_orderdate)) AS BIGINT) AS VARCHAR)", "content_categories": "'[\"' || o_orderpriority || '\"]'",
    "edited": "CASE WHEN o_orderpriority IN ('2-HIGH', '4-NOT SPECIFIED') THEN 'true' WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM') THEN 'false' END",
}


@registered(
    "normalise_post_all_columns",
    "SELECT " + ", ".join(f"coalesce({POST_VALUES_SQL.get(c, 'NULL')}, '-') AS {c}" for c in POST_COLUMNS) + " FROM orders",
)
def _(spark, sf_dir):
    posts = _cleaned(T.submission_lines(spark, sf_dir), "submissions", "post")
    return posts.select(*[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in POST_COLUMNS])


@registered(
    "top_posts_from_lines",
    """SELECT o_orderpriority || ' ' || o_orderkey AS title, CAST(floor(o_totalprice / 300) AS BIGINT) AS score
       FROM orders ORDER BY 2 DESC, 't3_' || o_orderkey LIMIT 10""",
)
def top_posts_from_lines(spark, sf_dir):
    """Raw lines to the top posts: parse, clean, project, rank."""
    posts = _cleaned(T.submission_lines(spark, sf_dir), "submissions", "post")
    return SQL_SUITE["analytical_top_posts_by_score"].build({"post": posts})


@registered(
    "edited_flag",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id,
              CASE WHEN o_orderpriority IN ('2-HIGH', '4-NOT SPECIFIED') THEN 'yes'
                   WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM') THEN 'no' ELSE 'unknown' END AS edited
       FROM orders""",
)
def _(spark, sf_dir):
    posts = _cleaned(T.submission_lines(spark, sf_dir), "submissions", "post")
    text = F.when(F.col("edited"), "yes").when(~F.col("edited"), "no").otherwise("unknown")
    return posts.select("id", text.alias("edited"))


def _ignored_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    machinery = T.table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "MACHINERY")
    return machinery.select(F.concat(F.lit("user_"), F.col("c_custkey").cast("string")).alias("name"))


@registered(
    "clean_author",
    """SELECT 't2_' || o_custkey AS author_fullname, ' User_' || o_custkey || chr(9) AS author,
              CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS author_premium
       FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn
             FROM orders WHERE o_orderstatus <> 'P'
               AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'))
       WHERE rn = 1""",
)
def clean_author(spark, sf_dir):
    registry = cleaners.default_cleaners(_ignored_customers(spark, sf_dir))
    authors = _cleaned(T.submission_lines(spark, sf_dir), "submissions", "author", registry)
    return keys.first_seen(authors, ["author_fullname"], ["row_id"]).select(
        "author_fullname", "author", F.when(F.col("author_premium"), "yes").otherwise("no").alias("author_premium")
    )


@registered("ignore_list", "SELECT DISTINCT lower(trim(' User_' || c_custkey || ' ')) AS name FROM customer")
def _(spark, sf_dir):
    path = scratch_path(spark, "names")
    names = F.concat(F.lit(" User_"), F.col("c_custkey").cast("string"), F.lit(" "))
    T.table(spark, sf_dir, "customer").select(names.alias("value")).write.text(path)
    return lists.read_ignore_list(spark, path)


@registered(
    "distinguished_posts",
    "SELECT CAST(o_orderkey AS VARCHAR) AS id, 'moderator' AS distinguished FROM orders WHERE o_orderstatus = 'P'",
)
def _(spark, sf_dir):
    rows = _cleaned(T.submission_lines(spark, sf_dir), "submissions", "distinguished_post")
    return rows.select("id", "distinguished")


@registered(
    "removed_posts",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')""",
)
def _(spark, sf_dir):
    return cleaners.clean_removed(_parsed(T.submission_lines(spark, sf_dir), "submissions")).select("id")


@registered(
    "pass_through_comments",
    """SELECT l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS id,
              CASE WHEN l_returnflag = 'R' THEN 'low score' ELSE '-' END AS collapsed_reason FROM lineitem""",
)
def _(spark, sf_dir):
    rows = _cleaned(T.comment_lines(spark, sf_dir), "comments", "collapsed_comment")
    return rows.select("id", F.coalesce("collapsed_reason", F.lit("-")).alias("collapsed_reason"))


@registered(
    "pass_through_distinguished_comments",
    """SELECT l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS id,
              't2_' || l_suppkey AS author_fullname,
              CASE WHEN l_linestatus = 'F' THEN 'moderator' ELSE '-' END AS distinguished FROM lineitem""",
)
def _(spark, sf_dir):
    rows = _cleaned(T.comment_lines(spark, sf_dir), "comments", "distinguished_comment").drop("row_id")
    return rows.fillna("-", "distinguished")


@registered(
    "skip_rule",
    """SELECT event_id FROM events
       WHERE event_type <> 'click' AND event_type <> 'view'
         AND (event_type <> 'error' OR value > 100)""",
)
def _(spark, sf_dir):
    """Clicks have no key, views an empty one; small errors have no other value at all."""
    kind = F.col("event_type")
    large = (kind == "error") & (F.col("value") > 100)
    line = F.to_json(
        F.struct(
            F.when(kind == "view", F.lit("")).when(kind != "click", F.col("event_id").cast("string")).alias("id"),
            F.when(kind == "error", F.lit("")).otherwise(kind).alias("collapsed_reason"),
            F.when(large, F.lit("seen")).alias("not_in_the_table"),
        ),
        {"ignoreNullFields": "false"},
    )
    events = T.table(spark, sf_dir, "events").select(line.alias("value"), "event_id")
    fields = DEFAULT_CATALOG.raw_fields("comments")
    return cleaners.apply_skip_rule(ndjson.parse_records(events, fields), ["id"]).select("event_id")


@registered(
    "rules_unpack",
    """WITH r AS (SELECT 'doc_' || doc_id AS subreddit, CASE WHEN lang <> 'fr' THEN lang END AS short_name, source,
                         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS priority,
                         unnest(string_split(text, chr(10))) AS description FROM documents)
       SELECT md5(subreddit || '_' || priority || '_' || coalesce(short_name, 'None') || '_' || description) AS rule_id,
              subreddit, priority, coalesce(short_name, '-') AS short_name, description, source AS kind FROM r""",
)
def _(spark, sf_dir):
    rules = _cleaned(T.rule_lines(spark, sf_dir), "subreddit_rules", "subreddit_rules")
    short_name = F.coalesce("short_name", F.lit("-")).alias("short_name")
    return rules.select("rule_id", "subreddit", "priority", short_name, "description", "kind")


@registered(
    "wiki_clean",
    """SELECT replace(url, '/en/', '/r/en_wiki/') AS path, 'en_wiki' AS subreddit, substring(html, 1, 500) AS content,
              page_id AS retrieved_on, 1735689600 + page_id * 3600 AS revision_date
       FROM pages WHERE contains(url, '/en/') AND NOT contains(url, 'ref=')""",
)
def _(spark, sf_dir):
    """Wiki text cut to its documented length on demand."""
    registry = cleaners.default_cleaners()
    registry.register("wiki", cleaners.wiki_cleaner(content_length=scalars.WIKI_CONTENT_LENGTH))
    return _cleaned(T.wiki_lines(spark, sf_dir), "subreddit_wikis", "wiki", registry).drop("row_id")


@registered(
    "wiki_full_text",
    """SELECT replace(url, '/en/', '/r/en_wiki/') AS path, html AS content
       FROM pages WHERE contains(url, '/en/') AND NOT contains(url, 'ref=')""",
)
def _(spark, sf_dir):
    return _cleaned(T.wiki_lines(spark, sf_dir), "subreddit_wikis", "wiki").select("path", "content")


@registered("rules_quarantine", "SELECT page_id AS row_id, 'bad_rules' AS fault FROM pages WHERE page_id % 2 = 0")
def _(spark, sf_dir):
    """Every second record has rules that are no list; none of them may vanish."""
    rules = F.when(F.col("page_id") % 2 == 0, F.lit("none")).otherwise(F.to_json(F.array(F.struct(F.lit("Be kind").alias("short_name")))))
    records = T.table(spark, sf_dir, "pages").select(F.col("page_id").alias("row_id"), F.col("url").alias("subreddit"), rules.alias("rules"))
    return cleaners.rules_faults(records).select("row_id", "fault")


@registered(
    "wiki_quarantine",
    """SELECT page_id AS row_id, 'bad_date' AS fault FROM pages WHERE contains(url, 'ref=')""",
)
def _(spark, sf_dir):
    return cleaners.wiki_faults(_parsed(T.wiki_lines(spark, sf_dir), "subreddit_wikis")).select("row_id", "fault")


@registered(
    "malformed_lines",
    """SELECT doc_id AS row_id, CASE WHEN lang = 'en' THEN 'malformed_json' ELSE 'sound' END AS fault FROM documents""",
)
def _(spark, sf_dir):
    """English documents are cut off before the closing brace."""
    line = F.to_json(F.struct("doc_id", "text", "lang"))
    cut = F.when(F.col("lang") == "en", F.expr("substring(line, 1, length(line) - 1)")).otherwise(F.col("line"))
    lines = T.table(spark, sf_dir, "documents").withColumn("line", line)
    parsed = ndjson.parse_records(lines.select(cut.alias("value"), F.col("doc_id").alias("row_id")), ["text"])
    return parsed.select("row_id", F.coalesce("fault", F.lit("sound")).alias("fault"))


@registered(
    "strip_nul",
    """SELECT doc_id, replace(text, ' ', '') AS text FROM documents""",
)
def _(spark, sf_dir):
    with_nul = F.replace("text", F.lit(" "), F.lit("\0"))
    return T.table(spark, sf_dir, "documents").select("doc_id", scalars.strip_nul(with_nul).alias("text"))


# ---------------------------------------------------------------- keys and sets


@registered(
    "first_seen_events",
    """SELECT user_id, event_id, event_type FROM
         (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""",
)
def _(spark, sf_dir):
    events = T.table(spark, sf_dir, "events")
    return keys.first_seen(events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@registered(
    "key_check", "SELECT l_orderkey, count(*) AS copies FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1"
)
def _(spark, sf_dir):
    return keys.duplicate_keys(T.table(spark, sf_dir, "lineitem"), ["l_orderkey"])


@registered(
    "key_copies",
    """SELECT event_id FROM
         (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn > 1""",
)
def _(spark, sf_dir):
    events = T.table(spark, sf_dir, "events").select("user_id", "event_id")
    return keys.later_copies(events, ["user_id"], ["event_id"])


@registered(
    "known_keys",
    "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
)
def _(spark, sf_dir):
    stored = T.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return keys.known_keys(T.table(spark, sf_dir, "customer"), ["c_custkey"], stored)


@registered("name_difference", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def _(spark, sf_dir):
    done = T.table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("id"))
    return keys.difference(T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), done)


@registered(
    "name_set_equality",
    """WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'),
            b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'O')
       SELECT id, 'left' AS side FROM a WHERE id NOT IN (SELECT id FROM b)
       UNION ALL SELECT id, 'right' FROM b WHERE id NOT IN (SELECT id FROM a)""",
)
def _(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders").withColumn("id", F.col("o_custkey"))
    left, right = (orders.filter(F.col("o_orderstatus") == s).select("id") for s in ("F", "O"))
    return keys.sets_differ(left, right)


@registered(
    "append_loads",
    """SELECT o_custkey AS id, o_orderpriority AS note FROM orders
       UNION ALL SELECT c_custkey, '-' FROM customer""",
)
def _(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("note"))
    customers = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return keys.append_loads(orders, customers).fillna("-", "note")


# ---------------------------------------------------------------- dump files

# Bytes of a block where dumps of the driver tables are read by blocks, so that their files have several.
EVENT_BLOCK = 1024 * 1024


@registered(
    "ndjson_scan", "SELECT event_id, user_id, event_type, props FROM events"
)
def _(spark, sf_dir):
    lines = ndjson.read_lines(spark, T.write_event_dump(spark, sf_dir))
    parsed = ndjson.parse_records(lines, ["event_id", "user_id", "event_type", "props"])
    return parsed.select(F.col("event_id").cast("bigint"), F.col("user_id").cast("bigint"), "event_type", "props")


@registered("first_n_lines", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 2500")
def _(spark, sf_dir):
    """The row cap of a load: the first 2500 lines of the dump, without reading on."""
    first = LineIndex(spark, T.write_event_dump(spark, sf_dir), scratch_path(spark, "line-index"), block_bytes=EVENT_BLOCK).first_lines(2500)
    parsed = ndjson.parse_records(first, ["event_id", "event_type"])
    return parsed.select(F.col("event_id").cast("bigint"), "event_type")


@registered("line_numbers", "SELECT row_number() OVER (ORDER BY event_id) AS line_no, event_id FROM events")
def _(spark, sf_dir):
    lines = ndjson.read_lines(spark, T.write_event_dump(spark, sf_dir))
    numbered = numbering.number_lines(lines, across_files=True)
    return numbered.select("line_no", F.get_json_object("value", "$.event_id").cast("bigint").alias("event_id"))


@registered("line_by_number", "SELECT event_id FROM events ORDER BY event_id LIMIT 1 OFFSET 776")
def _(spark, sf_dir):
    index = LineIndex(spark, T.write_event_dump(spark, sf_dir), scratch_path(spark, "line-index"), block_bytes=EVENT_BLOCK)
    index.cover()
    found = index.line_at(777)
    return found.select(F.get_json_object("value", "$.event_id").cast("bigint").alias("event_id"))


@registered("line_counts", "SELECT count(*) AS lines FROM events")
def _(spark, sf_dir):
    counts = profile.line_counts(spark, T.write_event_dump(spark, sf_dir))
    return counts.agg(F.sum("line_count").alias("lines"))


@registered("file_counts", "SELECT 'empty' AS kind, 0 AS lines UNION ALL SELECT 'filled', count(*) FROM events")
def _(spark, sf_dir):
    """Files without a line are counted too."""
    root = scratch_path(spark, "counted")
    lines = T.event_lines(spark, sf_dir).select("value")
    lines.write.text(f"{root}/filled")
    lines.limit(0).write.text(f"{root}/empty")
    counts = profile.line_counts(spark, root).withColumn("kind", F.element_at(F.split("path", "/"), -2))
    return counts.groupBy("kind").agg(F.sum("line_count").alias("lines"))


@registered(
    "file_discovery",
    """SELECT CASE WHEN event_type = 'click' THEN 'plain' ELSE 'with extension' END AS kind, count(*) AS lines FROM events GROUP BY 1""",
)
def _(spark, sf_dir):
    """Lines by kind of file: clicks in files without an extension, the other events in files that have one."""
    lines = T.event_lines(spark, sf_dir).select("value", F.contains("value", F.lit('"event_type"')).alias("named"))
    roots = [T.write_plain_dump(lines.filter("NOT named").select("value"), "plain-events"), scratch_path(spark, "other-events")]
    lines.filter("named").select("value").write.text(roots[1])
    plain = [ndjson.find_plain_files(spark, r).select(F.col("path"), F.lit("plain").alias("kind")) for r in roots]
    counts = profile.line_counts(spark, roots).join(keys.append_loads(*plain), "path", "left")
    kind = F.coalesce("kind", F.lit("with extension")).alias("kind")
    return counts.groupBy(kind).agg(F.sum("line_count").alias("lines"))


# Lines of a file that grows; sorting one takes a few tens of MB.
GROWING_LINES = 100_000


@registered("manifest_append", "SELECT 'blocks' AS hash_method, count(*) AS lines, 1 AS same_hash, 1 AS tail_only FROM events")
def _(spark, sf_dir):
    """Dump files that grew: the manifest of their first halves, brought up to date, is that of the whole files, and only their ends were read."""
    lines = T.event_lines(spark, sf_dir)
    # More files for more lines, so that the task that sorts a file holds no more of them.
    files = max(3, -(-lines.count() // GROWING_LINES))
    lines = lines.select("value", F.col("row_id"), F.pmod("row_id", F.lit(files)).alias("part"))
    half = lines.agg(F.percentile_approx("row_id", 0.5)).scalar()
    halves = lines.filter(F.col("row_id") <= half)
    roots = []
    for rows in (halves, lines):
        roots.append(scratch_path(spark, "growing"))
        rows.repartitionById(files, F.col("part").cast("int")).sortWithinPartitions("part", "row_id").select("value", "part").write.partitionBy("part").text(roots[-1])
    # The old entries under the names the grown files have.
    part = F.element_at(F.split("path", "/"), -2)
    names = byte_ranges.list_every_file(spark, roots[1]).select(part.alias("part"), F.col("path").alias("now"))
    old = manifest.block_manifest(spark, roots[0], block_bytes=4096).withColumn("part", part)
    stored = scratch_path(spark, "manifest")
    old.join(names, "part").withColumn("path", F.col("now")).drop("part", "now").write.parquet(stored)
    grown = manifest.file_manifest_of(manifest.block_manifest(spark, roots[1], spark.read.parquet(stored), block_bytes=4096))
    fresh = manifest.file_manifest_of(manifest.block_manifest(spark, roots[1], block_bytes=4096))
    met = grown.join(fresh.select("path", F.col("hash").alias("fresh"), F.col("bytes_read").alias("whole")), "path", "full")
    return met.groupBy("hash_method").agg(
        F.sum("line_count").alias("lines"), F.min((F.col("hash") == F.col("fresh")).cast("int")).alias("same_hash"),
        (F.sum("bytes_read") < F.sum("whole")).cast("int").alias("tail_only"),
    )


@registered("file_manifest", "SELECT 'content' AS hash_method, count(*) AS lines FROM events")
def _(spark, sf_dir):
    manifest = profile.file_manifest(spark, T.write_event_dump(spark, sf_dir))
    return manifest.groupBy("hash_method").agg(F.sum("line_count").alias("lines"))


@registered("manifest_update", "SELECT 'content' AS hash_method, 2 * count(*) AS lines FROM events")
def _(spark, sf_dir):
    """A second dump appears beside the first: only its files are read."""
    first, second = T.write_event_dump(spark, sf_dir), T.write_event_dump(spark, sf_dir)
    old = profile.file_manifest(spark, first)
    manifest = profile.update_manifest(spark, old, [first, second])
    return manifest.groupBy("hash_method").agg(F.sum("line_count").alias("lines"))


@registered("fingerprint_total", "SELECT count(*) AS lines, 1 AS same FROM events")
def _(spark, sf_dir):
    """The fingerprint of a file does not depend on how many tasks read it."""
    dump, setting = T.write_event_dump(spark, sf_dir), "spark.sql.files.maxPartitionBytes"
    before, found = spark.conf.get(setting), []
    try:
        for size in (before, "100k"):
            spark.conf.set(setting, size)
            found.append(scratch_path(spark, "fingerprints"))
            profile.content_fingerprints(ndjson.read_lines(spark, dump)).write.parquet(found[-1])
    finally:
        spark.conf.set(setting, before)
    once, again = (spark.read.parquet(p) for p in found)
    return once.join(again.select("path", F.col("hash").alias("other")), "path", "full").agg(
        F.sum("line_count").alias("lines"), F.min((F.col("hash") == F.col("other")).cast("int")).alias("same")
    )


@registered(
    "change_detect",
    """SELECT CAST(doc_id AS VARCHAR) AS path,
              CASE WHEN lang = 'fr' THEN 'new' WHEN lang = 'es' THEN 'gone'
                   WHEN lang = 'de' THEN 'changed' ELSE 'unchanged' END AS status FROM documents""",
)
def _(spark, sf_dir):
    """Documents as files: French ones appear, Spanish ones vanish, German ones change."""
    documents = T.table(spark, sf_dir, "documents").withColumn("path", F.col("doc_id").cast("string"))
    old = documents.filter(F.col("lang") != "fr").select("path", F.md5("text").alias("hash"))
    changed = F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = documents.filter(F.col("lang") != "es").select("path", F.md5(changed).alias("hash"))
    return profile.compare_manifests(old, new)


@registered(
    "manifest_refresh",
    """SELECT CAST(doc_id AS VARCHAR) AS path, n_chars AS line_count,
              md5(CASE WHEN lang = 'de' THEN text || '!' ELSE text END) AS hash FROM documents WHERE lang <> 'es'""",
)
def _(spark, sf_dir):
    documents = T.table(spark, sf_dir, "documents").withColumns(
        {"path": F.col("doc_id").cast("string"), "line_count": F.col("n_chars")}
    )
    old = documents.filter(F.col("lang") != "fr").select("path", "line_count", F.md5("text").alias("hash"))
    changed = F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = documents.filter(F.col("lang") != "es").select("path", "line_count", F.md5(changed).alias("hash"))
    return profile.refresh_manifest(old, new)


@registered(
    "max_length_profile",
    """WITH d AS (SELECT source, doc_id, text, coalesce(nullif(lang, 'fr'), 'None') AS lang, n_chars FROM documents)
       SELECT source, 'doc_id' AS key, max(length(CAST(doc_id AS VARCHAR))) AS max_length FROM d GROUP BY 1
       UNION ALL SELECT source, 'text', max(length(text)) FROM d GROUP BY 1
       UNION ALL SELECT source, 'lang', max(length(lang)) FROM d GROUP BY 1
       UNION ALL SELECT source, 'n_chars', max(length(CAST(n_chars AS VARCHAR))) FROM d GROUP BY 1""",
)
def _(spark, sf_dir):
    """The repeated leaf ``text`` at the start of the record is overwritten by the later one."""
    first = F.struct(F.concat("text", "text").alias("text"), F.array(F.lit("bare item")).alias("list"))
    line = F.to_json(
        F.struct(
            first.alias("draft"), F.struct("doc_id", "text").alias("body"),
            F.when(F.col("lang") != "fr", F.col("lang")).alias("lang"), F.array(F.struct("n_chars")).alias("sizes"),
        ),
        {"ignoreNullFields": "false"},
    )
    return nested.leaf_lengths(T.table(spark, sf_dir, "documents").select("source", line.alias("value")), "source")


@registered(
    "column_max_lengths",
    """SELECT 'c_custkey' AS key, max(length(CAST(c_custkey AS VARCHAR))) AS max_length FROM customer
       UNION ALL SELECT 'c_name', max(length(c_name)) FROM customer
       UNION ALL SELECT 'c_mktsegment', max(length(coalesce(nullif(c_mktsegment, 'AUTOMOBILE'), 'None'))) FROM customer""",
)
def _(spark, sf_dir):
    customers = T.table(spark, sf_dir, "customer")
    segment = F.when(F.col("c_mktsegment") != "AUTOMOBILE", F.col("c_mktsegment")).alias("c_mktsegment")
    return profile.column_max_lengths(customers.select("c_custkey", "c_name", segment))


@registered(
    "nested_paths",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'user,user.device,' ELSE 'user,' END
              || CASE WHEN event_type = 'view' THEN 'tags,tags' ELSE 'tags' END AS paths FROM events""",
)
def _(spark, sf_dir):
    found = nested.with_nested_paths(T.event_lines(spark, sf_dir))
    return found.select(F.col("row_id").alias("event_id"), F.array_join("nested_paths", ",").alias("paths"))


@registered(
    "key_list",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN 'event_id,user,tags,preview'
                             ELSE 'event_id,event_type,user,tags,preview' END AS keys,
              CASE WHEN event_type = 'click' THEN 4 ELSE 5 END AS n FROM events""",
)
def _(spark, sf_dir):
    return T.event_lines(spark, sf_dir).select(
        F.col("row_id").alias("event_id"),
        F.array_join(scalars.record_keys(F.col("value")), ",").alias("keys"),
        scalars.record_key_count(F.col("value")).alias("n"),
    )


@registered("json_document", "SELECT n_nationkey, n_name FROM nation")
def _(spark, sf_dir):
    """Side inputs kept as one JSON array per file and spread over several lines."""
    path = scratch_path(spark, "json-documents")
    key = F.col("n_nationkey").cast("string")
    array = F.concat(F.lit('[\n {"n_nationkey": '), key, F.lit(',\n "n_name": "'), F.col("n_name"), F.lit('"}\n]'))
    nations = T.table(spark, sf_dir, "nation")
    nations.select(array.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return ndjson.read_json_document(spark, path, "n_nationkey int, n_name string")


@registered(
    "first_with_values",
    "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'view') ORDER BY event_id LIMIT 1",
)
def _(spark, sf_dir):
    kind = F.col("event_type")
    events = T.table(spark, sf_dir, "events").withColumn(
        "awards", F.when(kind.isin("error", "view"), F.array(kind)).otherwise(F.array().cast("array<string>"))
    )
    return exploration.first_with_values(events, F.col("awards"), ["event_id"]).select("event_id", "event_type")


@registered(
    "author_counts",
    """SELECT count(DISTINCT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END) AS unique_authors,
              count(*) FILTER (o_orderstatus = 'P') AS deleted_count FROM orders""",
)
def _(spark, sf_dir):
    author = F.when(F.col("o_orderstatus") == "P", exploration.DELETED_AUTHOR).otherwise(F.col("o_custkey").cast("string"))
    return exploration.author_counts(T.table(spark, sf_dir, "orders").select(author.alias("author")))


@registered("known_authors", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'")
def _(spark, sf_dir):
    author = F.when(F.col("o_orderstatus") == "P", exploration.DELETED_AUTHOR).otherwise(F.col("o_custkey").cast("string"))
    orders = T.table(spark, sf_dir, "orders").withColumn("author", author)
    return exploration.not_deleted(orders).select("o_orderkey")


@registered("prefix_columns", "SELECT o_orderkey, o_orderstatus, o_orderdate::DATE::VARCHAR AS o_orderdate, o_orderpriority FROM orders")
def _(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return exploration.prefixed_columns(orders, "o_order")


@registered(
    "column_groups",
    """SELECT 'metadata_keys' AS part, CAST(o_orderkey AS VARCHAR) AS id, 't3_' || o_orderkey AS value FROM orders
       UNION ALL SELECT 'post_content_keys', CAST(o_orderkey AS VARCHAR), o_orderpriority || ' ' || o_orderkey FROM orders
       UNION ALL SELECT 'author_keys', CAST(o_orderkey AS VARCHAR), ' User_' || o_custkey || chr(9) FROM orders""",
)
def _(spark, sf_dir):
    records = _parsed(T.submission_lines(spark, sf_dir), "submissions")
    groups = exploration.column_groups(records)
    shown = {"metadata_keys": "name", "post_content_keys": "title", "author_keys": "author"}
    parts = [groups[g].select(F.lit(g).alias("part"), "id", F.col(c).alias("value")) for g, c in shown.items()]
    return keys.append_loads(*parts)


@registered(
    "nested_values",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN '-' ELSE '["' || event_type || '"]' END AS tags,
              CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS n FROM events""",
)
def _(spark, sf_dir):
    kind = F.col("event_type")
    tags = F.when(kind != "click", F.array(kind)).otherwise(F.array().cast("array<string>"))
    events = T.table(spark, sf_dir, "events").withColumn("tags", tags)
    return events.select(
        "event_id", F.coalesce(scalars.nested_array_text(F.col("tags")), F.lit("-")).alias("tags"), scalars.array_size(F.col("tags")).alias("n")
    )


@registered(
    "column_functions",
    """SELECT doc_id, split_part(source || '_' || lang, '_', 1) AS category, 'file_' || doc_id AS name,
              round(n_chars / 1024.0, 4) AS megabytes,
              CASE WHEN n_chars * 100 < 1024 THEN printf('%.2f bytes', n_chars * 100.0)
                   WHEN n_chars * 100 < 1048576 THEN printf('%.2f KB', n_chars * 100 / 1024.0)
                   ELSE printf('%.2f MB', n_chars * 100 / 1048576.0) END AS size,
              n_chars AS seconds, lang AS first_tag
       FROM documents""",
)
def _(spark, sf_dir):
    start = F.lit("2025-01-01 00:00:00").cast("timestamp")
    end = F.timestamp_seconds(F.unix_seconds(start) + F.col("n_chars"))
    tags = scalars.array_field(F.array(F.struct(F.col("lang").alias("tag"))), "tag")
    return T.table(spark, sf_dir, "documents").select(
        "doc_id",
        scalars.name_category(F.concat_ws("_", "source", "lang")).alias("category"),
        scalars.last_segment(F.concat(F.lit("data/dump/file_"), F.col("doc_id").cast("string"))).alias("name"),
        F.round(scalars.kilobytes_to_megabytes(F.col("n_chars")), 4).alias("megabytes"),
        scalars.readable_size(F.col("n_chars") * 100).alias("size"),
        scalars.elapsed_seconds(start, end).alias("seconds"),
        tags[0].alias("first_tag"),
    )


# ---------------------------------------------------------------- documents

DOCUMENT_FIELDS = "id string, name string, title string, author_fullname string, author string, score bigint"


@registered(
    "document_scan",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, 't3_' || o_orderkey AS name,
              CAST(floor(o_totalprice / 300) AS BIGINT) AS score FROM orders""",
)
def _(spark, sf_dir):
    documents = ndjson.read_documents(T.submission_lines(spark, sf_dir), ["name"])
    return document_table(documents, DOCUMENT_FIELDS).select("id", "name", "score")


@registered(
    "document_store",
    """SELECT 't3_' || o_orderkey AS name, CAST(floor(o_totalprice / 300) AS BIGINT) AS score FROM orders""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "documents")
    documents = ndjson.read_documents(T.submission_lines(spark, sf_dir), ["name"])
    sinks.write_documents(documents, path, ["name"], "first")
    stored = sinks.read_table(spark, path)
    return stored.select("name", F.expr("variant_get(doc, '$.score', 'bigint')").alias("score"))


@registered(
    "top_posts_from_documents",
    """SELECT o_orderpriority || ' ' || o_orderkey AS title, CAST(floor(o_totalprice / 300) AS BIGINT) AS score
       FROM orders ORDER BY 2 DESC, 't3_' || o_orderkey LIMIT 10""",
)
def _(spark, sf_dir):
    documents = ndjson.read_documents(T.submission_lines(spark, sf_dir), ["name"])
    return DOCUMENT_SUITE["analytical_top_posts_by_score"].build({"post": document_table(documents, DOCUMENT_FIELDS)})


# ---------------------------------------------------------------- sinks

POSTS_SQL = _archive_sql("SELECT id, name, title, score FROM post")


def _post_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.posts(spark, sf_dir).select("id", "name", "title", "score")


@registered("append_table", POSTS_SQL)
def _(spark, sf_dir):
    """Two loads, the second one run twice: a repeated load replaces its own rows."""
    path = scratch_path(spark, "append")
    rows = _post_rows(spark, sf_dir).withColumn("high", F.col("score") > 800)
    sinks.append_load(rows.filter("high").drop("high"), path, "first")
    for _ in range(2):
        sinks.append_load(rows.filter("NOT high").drop("high"), path, "second")
    return sinks.read_table(spark, path)


@registered("replace_table", POSTS_SQL)
def _(spark, sf_dir):
    path = scratch_path(spark, "replace")
    rows = _post_rows(spark, sf_dir)
    sinks.replace_table(rows.filter("score > 800"), path)
    sinks.replace_table(rows, path)
    return sinks.read_table(spark, path)


@registered("key_layout", POSTS_SQL)
def _(spark, sf_dir):
    path = scratch_path(spark, "layout")
    sinks.replace_table(sinks.with_key_layout(_post_rows(spark, sf_dir), ["name"]), path)
    return sinks.read_table(spark, path)


@registered("join_key_layout", _archive_sql("SELECT parent_id, count(*) AS n FROM comment GROUP BY 1"))
def _(spark, sf_dir):
    """Comments laid out by the post they answer; a post with very many comments spans several files."""
    path = scratch_path(spark, "join-layout")
    sinks.replace_table(sinks.with_key_layout(T.comments(spark, sf_dir), ["parent_id"], spread=["id"]), path)
    return sinks.read_table(spark, path).groupBy("parent_id").agg(F.count("*").alias("n"))


@registered("export_first_lines", "SELECT event_id FROM events ORDER BY event_id LIMIT 2500")
def _(spark, sf_dir):
    path = scratch_path(spark, "export-first")
    json_files.export_sound_lines(first_lines_of(spark, T.write_event_dump(spark, sf_dir), 2500), path)
    return spark.read.schema("event_id bigint").json(path)


@registered("export_batches", "SELECT event_id, user_id FROM events")
def _(spark, sf_dir):
    path = scratch_path(spark, "export-batches")
    json_files.export_batches(ndjson.read_lines(spark, T.write_event_dump(spark, sf_dir)), path)
    lines = spark.read.schema("line string").json(path)
    return lines.select(F.from_json("line", "event_id bigint, user_id bigint").alias("r")).select("r.*")


@registered("quarantine_write", "SELECT page_id AS row_id, 'bad_date' AS fault FROM pages WHERE contains(url, 'ref=')")
def _(spark, sf_dir):
    path = scratch_path(spark, "quarantine")
    faults = cleaners.wiki_faults(_parsed(T.wiki_lines(spark, sf_dir), "subreddit_wikis"))
    sinks.quarantine(faults.withColumn("kind", F.lit("wiki")), path, "first")
    return spark.read.parquet(path).select("row_id", "fault")


@registered(
    "catalog_tables", _archive_sql("SELECT author_fullname, author FROM author")
)
def _(spark, sf_dir):
    """Create the missing tables, load one, drop the others again."""
    location = scratch_path(spark, "catalog")
    database = "loom_" + location[-32:]
    spark.sql(f"CREATE DATABASE {database} LOCATION '{location}'")
    small = Catalog(
        columns={t: DEFAULT_CATALOG.columns[t] for t in ("author", "wiki")},
        keys=DEFAULT_CATALOG.keys,
        sources={"submissions": Source("submissions", ("author",), "post")},
    )
    names = sinks.create_tables(spark, small, database)
    rows = T.authors(spark, sf_dir).withColumn("author_premium", F.lit(None).cast("boolean"))
    rows.write.insertInto(f"{database}.author")
    finished = spark.createDataFrame([(f"{database}.author",)], "name string")
    sinks.drop_unfinished(spark, names, finished, overwrite=True)
    return spark.table(f"{database}.author").select("author_fullname", "author")


@registered("table_size")
def _(spark, sf_dir):
    path = scratch_path(spark, "sized")
    sinks.replace_table(_post_rows(spark, sf_dir), path)
    sizes = profile.storage_sizes(spark, {"post": path, "orders": f"{sf_dir}/orders.parquet"})
    return sizes.select(
        "name",
        "size_bytes",
        scalars.bytes_to_gigabytes(F.col("size_bytes")).alias("size_gb"),
        scalars.readable_size(F.col("size_bytes")).alias("size_text"),
    )


@registered(
    "size_listing",
    """SELECT source AS name, sum(n_chars)::BIGINT AS size_bytes, round(sum(n_chars) / 1073741824.0, 9) AS size_gb,
              CASE WHEN sum(n_chars) < 1024 THEN format('{:.2f} bytes', sum(n_chars)::DOUBLE)
                   WHEN sum(n_chars) < 1048576 THEN format('{:.2f} KB', round_even(sum(n_chars) / 1024.0, 2))
                   WHEN sum(n_chars) < 1073741824 THEN format('{:.2f} MB', round_even(sum(n_chars) / 1048576.0, 2))
                   ELSE format('{:.2f} GB', round_even(sum(n_chars) / 1073741824.0, 2)) END AS size_text
       FROM documents GROUP BY 1""",
)
def _(spark, sf_dir):
    """Sizes summed from a listing, here that of the documents by source."""
    listing = T.table(spark, sf_dir, "documents").select(F.col("source").alias("name"), F.col("n_chars").alias("length"))
    sizes = profile.summed_sizes(listing)
    return sizes.select(
        "name", "size_bytes", F.round(scalars.bytes_to_gigabytes(F.col("size_bytes")), 9).alias("size_gb"),
        scalars.readable_size(F.col("size_bytes")).alias("size_text"),
    )


# ---------------------------------------------------------------- loads


def _loaded(spark: SparkSession, sf_dir: str) -> load.Store:
    store = load.Store(scratch_path(spark, "store"))
    dump = T.write_dump(T.submission_lines(spark, sf_dir), "submissions-dump")
    registry = cleaners.default_cleaners(_ignored_customers(spark, sf_dir))
    load.load_source(spark, "submissions", dump, store, registry)
    return store


@registered("load_posts", ORACLE["normalise_post"])
def _(spark, sf_dir):
    posts = load.read_loaded(spark, _loaded(spark, sf_dir), "post")
    return posts.select("id", "name", "title", "score", "created_utc", "content_categories")


@registered("load_authors", ORACLE["clean_author"])
def _(spark, sf_dir):
    authors = load.read_loaded(spark, _loaded(spark, sf_dir), "author")
    return authors.withColumn("author_premium", F.when(F.col("author_premium"), "yes").otherwise("no"))


@registered("load_summary", "SELECT count(*) AS line_count, 'author,distinguished_post,post' AS tables, 3 AS writes FROM orders")
def _(spark, sf_dir):
    summary = load.summary(spark, _loaded(spark, sf_dir))
    return summary.select("line_count", F.array_join(F.array_sort("tables"), ",").alias("tables"), "writes")


def _half_dump(spark: SparkSession, sf_dir: str, odd: int) -> str:
    """A dump of the submissions that are orders with an even or with an odd key."""
    lines = T.submission_lines(spark, sf_dir, in_order=True)
    return T.write_dump(lines.filter(F.col("row_id") % 2 == odd), f"submissions-{odd}", in_order=True)


@registered(
    "load_snapshot",
    """SELECT moment, "table", n FROM (
         SELECT 'post' AS "table", (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0) AS even, (SELECT count(*) FROM orders) AS every
         UNION ALL SELECT 'author', (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 2 = 0),
                          (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus <> 'P')
         UNION ALL SELECT 'distinguished_post', (SELECT count(*) FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 2 = 0),
                          (SELECT count(*) FROM orders WHERE o_orderstatus = 'P')) t,
       LATERAL (VALUES ('killed', even), ('resumed', every), ('first version', even)) AS m(moment, n)""",
)
def _(spark, sf_dir):
    """A load that dies at its last table shows no row of the others; run again, it shows all tables at once, and the snapshot before it stays readable."""
    store, (first, second) = load.Store(scratch_path(spark, "snapshots")), (_half_dump(spark, sf_dir, odd) for odd in (0, 1))
    load.load_source(spark, "submissions", first, store)
    broken = cleaners.default_cleaners()
    broken.register("distinguished_post", lambda rows: rows.filter(F.when(F.rand(1) >= 0, F.raise_error(F.lit("killed"))).isNull()))
    try:
        load.load_source(spark, "submissions", second, store, broken, on_duplicate="keep")
    except PySparkException:
        pass

    def counts(moment: str, version: int | None = None) -> list[DataFrame]:
        tables = DEFAULT_CATALOG.sources["submissions"].tables
        rows = [(t, load.read_loaded(spark, store, t, version=version)) for t in tables]
        return [r.agg(F.lit(moment).alias("moment"), F.lit(t).alias("table"), F.count("*").alias("n")) for t, r in rows]

    killed = counts("killed")
    load.load_source(spark, "submissions", second, store)
    return keys.append_loads(*killed, *counts("resumed"), *counts("first version", 1))


@registered(
    "resume_quarantine",
    """SELECT 'submissions' AS "table", 'malformed_json' AS fault, count(*) AS n FROM orders WHERE o_orderpriority = '5-LOW'
       UNION ALL SELECT 'post', 'bad_value:score', count(*) FROM orders WHERE o_orderpriority = '1-URGENT'
       UNION ALL SELECT 'author', 'key_missing', count(*) FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderstatus = 'P'""",
)
def _(spark, sf_dir):
    """Posts are loaded alone and the other tables of the dump later: what the first load set aside stays, and nothing is set aside twice."""
    store = load.Store(scratch_path(spark, "resumed"))
    lines = T.submission_lines(spark, sf_dir)
    value = F.regexp_replace("value", '"score":[0-9]+', '"score":"many"')
    value = F.when(F.contains("value", F.lit('"title":"1-URGENT')), value).otherwise(F.col("value"))
    value = F.when(F.contains("value", F.lit('"title":"5-LOW')), F.expr("substring(value, 1, length(value) - 1)")).otherwise(value)
    dump = T.write_dump(lines.withColumn("value", value), "submissions-faulty")
    posts = replace(DEFAULT_CATALOG, sources={"submissions": replace(DEFAULT_CATALOG.sources["submissions"], tables=("post",))})
    load.load_source(spark, "submissions", dump, store, catalog=posts)
    load.load_source(spark, "submissions", dump, store)
    return load.read_quarantine(spark, store).groupBy("table", "fault").agg(F.count("*").alias("n"))


@registered(
    "load_known_keys",
    "SELECT 't3_' || o_orderkey AS name, o_orderkey % 2 AS later_copies FROM orders",
)
def _(spark, sf_dir):
    """Odd orders are loaded, then all: the key filters of the first load find its keys, which are set aside in the second."""
    store, odd = load.Store(scratch_path(spark, "known")), _half_dump(spark, sf_dir, 1)
    load.load_source(spark, "submissions", odd, store)
    every = T.write_dump(T.submission_lines(spark, sf_dir, in_order=True), "submissions-all", in_order=True)
    load.load_source(spark, "submissions", every, store, on_duplicate="quarantine")
    posts = load.read_loaded(spark, store, "post").select("name", F.lit(0).alias("copies"))
    aside = load.read_quarantine(spark, store).filter("fault = 'key_repeated' AND table = 'post'")
    copies = aside.select(F.get_json_object("value", "$.name").alias("name"), F.lit(1).alias("copies"))
    return posts.unionByName(copies).groupBy("name").agg(F.sum("copies").cast("bigint").alias("later_copies"))


@registered(
    "load_resume_ledger",
    """SELECT 1 AS run, 'post' AS written, 'post' AS ledger, count(*) AS posts FROM orders
       UNION ALL SELECT 2, 'author,distinguished_post', 'author,distinguished_post,post', count(*) FROM orders
       UNION ALL SELECT 3, '', 'author,distinguished_post,post', count(*) FROM orders""",
)
def _(spark, sf_dir):
    """Posts first, then what is missing of the dump, then nothing: the ledger decides what a load still has to do."""
    store, dump = load.Store(scratch_path(spark, "ledger")), T.write_dump(T.submission_lines(spark, sf_dir), "submissions-ledger")
    posts = replace(DEFAULT_CATALOG, sources={"submissions": replace(DEFAULT_CATALOG.sources["submissions"], tables=("post",))})
    rows = []
    for run, catalog in enumerate((posts, DEFAULT_CATALOG, DEFAULT_CATALOG), 1):
        written = load.load_source(spark, "submissions", dump, store, catalog=catalog)
        # One entry; taken now, as Spark holds reads of one folder at different times for the same.
        held = load.ledger_entries(load.ledger(spark, store)).first()["success_tables"]
        count = load.read_loaded(spark, store, "post").agg(F.count("*").alias("posts"))
        rows.append(count.select(F.lit(run).alias("run"), F.lit(",".join(written)).alias("written"), F.lit(",".join(held)).alias("ledger"), "posts"))
    return keys.append_loads(*rows)


@registered(
    "load_ledger",
    """SELECT o_orderpriority AS file, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS success_tables
       FROM orders GROUP BY 1""",
)
def _(spark, sf_dir):
    ledger = T.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("file"), F.col("o_orderstatus").alias("table"))
    return load.ledger_entries(ledger).withColumn("success_tables", F.array_join("success_tables", ","))


@registered(
    "load_archive",
    """WITH good AS (SELECT * FROM pages WHERE contains(url, '/en/') AND NOT contains(url, 'ref=')),
            rule AS (SELECT unnest(string_split(text, chr(10))) FROM documents)
       SELECT 'wiki' AS "table", (SELECT count(*) FROM good) AS n
       UNION ALL SELECT 'revision_wiki', (SELECT count(*) FROM pages)
       UNION ALL SELECT 'subreddit_rules', (SELECT count(*) FROM rule)""",
)
def _(spark, sf_dir):
    """A map of two sources to their dump files, loaded into one store. Pages may share an address, which is the key of wikis: the first
    row of a key is loaded and its copies are set aside, and both are counted."""
    store = load.Store(scratch_path(spark, "archive"))
    wikis = T.write_dump(T.wiki_lines(spark, sf_dir), "wikis")
    rules = T.write_dump(T.rule_lines(spark, sf_dir), "rules")
    load.load_archive(spark, {"subreddit_wikis": [wikis], "subreddit_rules": [rules]}, store, on_duplicate="quarantine")
    tables = ("wiki", "revision_wiki", "subreddit_rules")
    aside = load.read_quarantine(spark, store).filter("fault = 'key_repeated'").select("table")
    rows = [load.read_loaded(spark, store, t).select(F.lit(t).alias("table")).unionByName(aside.filter(F.col("table") == t)) for t in tables]
    # Each count is an aggregate without groups, so that a table without rows has its line too.
    return keys.append_loads(*[r.agg(F.lit(t).alias("table"), F.count("*").alias("n")) for t, r in zip(tables, rows, strict=True)])


def _ledger_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ledger entries: what was loaded, and what is said to be free of duplicates."""
    done = F.when(F.col("o_orderstatus") == "P", F.array(F.lit("post"))).otherwise(F.array(F.lit("post"), F.lit("author")))
    return T.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("file"),
        done.alias("success_tables"),
        F.array(F.lit("author"), F.col("o_orderpriority")).alias("duplicates_removed"),
    )


@registered(
    "ledger_hygiene",
    "SELECT o_orderkey AS file, CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'author' END AS duplicates_removed FROM orders",
)
def _(spark, sf_dir):
    entries = load.clean_ledger(_ledger_arrays(spark, sf_dir))
    return entries.select("file", F.array_join("duplicates_removed", ",").alias("duplicates_removed"))


@registered(
    "ledger_deduplicated_tables",
    """SELECT DISTINCT o_orderpriority AS "table" FROM orders UNION SELECT 'author'""",
)
def _(spark, sf_dir):
    return load.deduplicated_tables(_ledger_arrays(spark, sf_dir))


def _streamed(spark: SparkSession, sf_dir: str) -> load.Store:
    store = load.Store(scratch_path(spark, "stream-store"))
    dump = T.write_dump(T.submission_lines(spark, sf_dir), "submissions-stream")
    registry = cleaners.default_cleaners(_ignored_customers(spark, sf_dir))
    lines = stream_lines(spark, dump)
    stream_source(lines, "submissions", store, scratch_path(spark, "stream-state"), registry=registry).awaitTermination()
    return store


@registered("stream_load", ORACLE["normalise_post"])
def _(spark, sf_dir):
    posts = load.read_loaded(spark, _streamed(spark, sf_dir), "post")
    return posts.select("id", "name", "title", "score", "created_utc", "content_categories")


@registered("stream_first_seen", ORACLE["clean_author"].replace(", ' User_' || o_custkey || chr(9) AS author,\n              CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS author_premium", ""))
def _(spark, sf_dir):
    return load.read_loaded(spark, _streamed(spark, sf_dir), "author").select("author_fullname")


@registered(
    "stream_first_arrivals",
    """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn = 1""",
)
def _(spark, sf_dir):
    """The first event of each user over micro-batches of one file, whose files come in no order of the events."""
    path = scratch_path(spark, "arriving")
    T.event_lines(spark, sf_dir).select("value", "row_id").repartition(3, "row_id").select("value").write.text(path)
    user = F.get_json_object("value", "$.user.id").cast("bigint").alias("user_id")
    rows = stream_lines(spark, path, files_per_batch=1).select(user, F.get_json_object("value", "$.event_id").cast("bigint").alias("event_id"))
    out = scratch_path(spark, "arrived")
    stream_first_arrivals(rows, ["user_id"], ["event_id"], out, scratch_path(spark, "arrivals-state")).awaitTermination()
    return latest_revisions(spark.read.schema("user_id bigint, event_id bigint, revision bigint").parquet(out), ["user_id"])


@registered("stream_any_per_key", "SELECT DISTINCT event_type FROM events")
def _(spark, sf_dir):
    lines = stream_lines(spark, T.write_event_dump(spark, sf_dir))
    kinds = lines.select(F.get_json_object("value", "$.event_type").alias("event_type"))
    path = scratch_path(spark, "stream-kinds")
    stream_any_per_key(kinds, ["event_type"], path, scratch_path(spark, "stream-kinds-state")).awaitTermination()
    return spark.read.schema("event_type string").parquet(path)


# ---------------------------------------------------------------- analysis of recorded runs

RUNS_SQL = """WITH r AS (SELECT l_returnflag || '_' || l_linestatus AS query, 'sys' || l_linenumber AS system,
  l_extendedprice AS time, l_quantity AS memory,
  CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'N' AND l_linenumber = 1 THEN CAST(floor(l_quantity) AS BIGINT) + 100
  ELSE CAST(floor(l_quantity) AS BIGINT) END AS output_length FROM lineitem
  WHERE NOT (l_linenumber = 7 AND l_returnflag = 'R' AND l_linestatus = 'F')),
m AS (SELECT query, system, avg(time) AS t, avg(memory / 1024) AS mb FROM r GROUP BY 1, 2)
"""


def _pivot_sql(value: str, key: str, round_to: int = 2, default: str | None = None) -> str:
    def cell(s: str) -> str:
        base = f"round({value} FILTER (system = '{s}'), {round_to})"
        return (base if default is None else f"coalesce({base}, {default})") + f" AS {s}"

    return f"SELECT {key}, " + ", ".join(cell(s) for s in T.SYSTEMS)


def _rounded(df: DataFrame, places: int = 2, default: float | None = None) -> DataFrame:
    def show(name: str):
        value = F.round(name, places)
        return (value if default is None else F.coalesce(value, F.lit(default))).alias(name)

    return df.select(*[show(c) if c in T.SYSTEMS else F.col(c) for c in df.columns])


@registered("recorded_runs", "WITH n AS (SELECT l_linenumber, count(*) AS runs FROM lineitem GROUP BY 1) SELECT 'sys' || l_linenumber AS system, runs FROM n WHERE l_linenumber < 7 UNION ALL SELECT 'sys7', count(*) FROM lineitem WHERE l_linenumber = 7 AND l_returnflag <> 'R'")
def _(spark, sf_dir):
    """Runs without output are not recorded."""
    path = scratch_path(spark, "runs")
    runs = T.runs(spark, sf_dir)
    empty = (F.col("system") == "sys7") & F.col("query").startswith("R")
    results.append_runs(runs.withColumn("output_length", F.when(empty, 0).otherwise(F.col("output_length"))), path)
    return spark.read.parquet(path).groupBy("system").agg(F.count("*").alias("runs"))


@registered("metric_means", RUNS_SQL + _pivot_sql("avg(time)", "query", default="-1") + " FROM r GROUP BY query")
def _(spark, sf_dir):
    return _rounded(results.query_means(T.runs(spark, sf_dir), T.SYSTEMS), default=-1.0)


@registered("memory_means", RUNS_SQL + _pivot_sql("avg(memory / 1024)", "query", 6, "-1") + " FROM r GROUP BY query")
def _(spark, sf_dir):
    return _rounded(results.query_means(T.runs(spark, sf_dir), T.SYSTEMS, "memory"), 6, -1.0)


@registered(
    "category_means", RUNS_SQL + _pivot_sql("avg(t)", "split_part(query, '_', 1) AS category") + " FROM m GROUP BY 1"
)
def _(spark, sf_dir):
    return _rounded(results.category_means(T.runs(spark, sf_dir), T.SYSTEMS))


@registered(
    "too_slow_bound",
    RUNS_SQL
    + "SELECT query, "
    + ", ".join(f"round(coalesce(avg(t) FILTER (system = '{s}'), max(t)), 2) AS {s}" for s in T.SYSTEMS)
    + ", "
    + ", ".join(f"CAST(count(*) FILTER (system = '{s}') = 0 AS INTEGER) AS {s}_too_slow" for s in T.SYSTEMS)
    + " FROM m GROUP BY query",
)
def _(spark, sf_dir):
    bounded = _rounded(results.bounded_query_means(T.runs(spark, sf_dir), T.SYSTEMS))
    return bounded.select(*[F.col(c).cast("int").alias(c) if c.endswith("_too_slow") else c for c in bounded.columns])


@registered(
    "too_slow_category_bound",
    RUNS_SQL
    + """, c AS (SELECT split_part(query, '_', 1) AS category, system, avg(t) AS t, count(*) AS n FROM m GROUP BY 1, 2),
         k AS (SELECT category, system, t FROM c WHERE n = 2) SELECT category, """
    + ", ".join(f"round(coalesce(avg(t) FILTER (system = '{s}'), max(t)), 2) AS {s}" for s in T.SYSTEMS)
    + ", "
    + ", ".join(f"CAST(count(*) FILTER (system = '{s}') = 0 AS INTEGER) AS {s}_too_slow" for s in T.SYSTEMS)
    + " FROM k GROUP BY category",
)
def _(spark, sf_dir):
    bounded = _rounded(results.bounded_category_means(T.runs(spark, sf_dir), T.SYSTEMS))
    return bounded.select(*[F.col(c).cast("int").alias(c) if c.endswith("_too_slow") else c for c in bounded.columns])


@registered(
    "consistency_within",
    RUNS_SQL
    + """SELECT query, system, min(output_length) AS min_length, max(output_length) AS max_length FROM r
         GROUP BY 1, 2 HAVING min(output_length) <> max(output_length)""",
)
def _(spark, sf_dir):
    return results.varying_lengths(T.runs(spark, sf_dir))


@registered(
    "consistency_across",
    RUNS_SQL
    + """, s AS (SELECT query, count(DISTINCT system) AS systems FROM r GROUP BY 1),
         l AS (SELECT query, output_length, count(DISTINCT system) AS seen_in FROM r GROUP BY 1, 2)
         SELECT query, systems, count(*) AS unshared_lengths FROM l JOIN s USING (query)
         WHERE seen_in < systems GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    return results.unequal_lengths(T.runs(spark, sf_dir))


@registered(
    "import_pivot",
    "SELECT o_orderstatus AS system, "
    + ", ".join(
        f"CAST(sum(o_custkey) FILTER (replace(o_orderpriority, ' ', '_') = '{f}') AS BIGINT) AS \"{f}\"" for f in T.LOAD_FILES
    )
    + ", CAST(CASE WHEN sum(o_custkey) = 0 THEN -1 ELSE sum(o_custkey) END AS BIGINT) AS total FROM orders GROUP BY 1",
)
def _(spark, sf_dir):
    return results.import_times(T.loads(spark, sf_dir), T.LOAD_FILES)


@registered(
    "import_by_size",
    "SELECT CASE WHEN floor(o_totalprice) >= 300000 THEN 'large' ELSE 'small' END AS category, "
    + ", ".join(f"round(avg(o_custkey) FILTER (o_orderstatus = '{s}'), 4) AS {s}" for s in T.LOAD_SYSTEMS)
    + " FROM orders GROUP BY 1",
)
def _(spark, sf_dir):
    table = results.import_times_by_size(T.loads(spark, sf_dir), T.LOAD_SYSTEMS, 300000)
    return table.select("category", *[F.round(s, 4).alias(s) for s in T.LOAD_SYSTEMS])


@registered(
    "planned_runs", RUNS_SQL + "SELECT count(DISTINCT query) * count(DISTINCT system) AS planned FROM r"
)
def _(spark, sf_dir):
    runs = T.runs(spark, sf_dir)
    return results.planned_runs(runs, runs)


RUNNER_KINDS = tuple(dict.fromkeys(q.kind for q in SQL_SUITE.values()))


@registered(
    "suite_runner",
    _archive_sql(
        " UNION ALL ".join(
            f"SELECT * FROM (SELECT 'archive' AS system, '{n}' AS query, (SELECT count(*) FROM ({SUITE_ORACLE[n]})) AS output_length) WHERE output_length > 0"
            for n, q in SQL_SUITE.items()
            if q.kind in RUNNER_KINDS
        )
    ),
)
def _(spark, sf_dir):
    """Every class of the suite, each run kept in a ledger when it ends."""
    runs = run_suite(spark, SQL_SUITE, {"archive": T.archive(spark, sf_dir)}, kinds=RUNNER_KINDS, ledger=scratch_path(spark, "run-ledger"))
    return runs.select("system", "query", "output_length")
