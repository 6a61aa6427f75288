"""The query suite over the normalised tables: simple, join, analytical and nested queries.

Each query has a SQL form, a DataFrame form, or both, over the tables it names. The document forms
are the variants kept for collections; they differ from the SQL forms where the note says so. Every
limit has a key tiebreaker, so ties cannot change a result between runs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.lookups import array_lookup, lookup_unwind

Tables = Mapping[str, DataFrame]

# Limits and thresholds of the suite.
TOP_POSTS = 10
ACTIVE_GROUPS = 10
COMMENTED_POSTS = 50
HIGH_AVERAGE = 1000
HIGH_AVERAGE_GROUPS = 100
LOOKUP_POSTS = 5


@dataclass(frozen=True)
class SuiteQuery:
    name: str
    kind: str
    inputs: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None = None
    note: str = ""

    def from_sql(self, spark: SparkSession, tables: Tables) -> DataFrame:
        if self.sql is None:
            raise ValueError(f"{self.name} has no SQL form")
        return spark.sql(self.sql, **{name: tables[name] for name in self.inputs})


def _top(df: DataFrame, measure: str, count: int, *tiebreak: str) -> DataFrame:
    return df.orderBy(F.col(measure).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in tiebreak]).limit(count)


def select_authors(t: Tables) -> DataFrame:
    return t["author"].select("author_fullname", "author")


def count_rows(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias(name))


def unique_subreddits(t: Tables) -> DataFrame:
    return t["post"].select("subreddit_id").distinct()


def posts_with_authors(t: Tables) -> DataFrame:
    posts = t["post"].select("id", "title", "author_fullname")
    return posts.join(t["author"].select("author_fullname", "author"), "author_fullname").select(
        "id", "title", "author"
    )


def posts_with_subreddits(t: Tables) -> DataFrame:
    posts = t["post"].select("id", "title", "subreddit_id")
    return lookup_unwind(posts, t["subreddit"].select("name", "display_name"), "subreddit_id", "name").select(
        "id", "title", "display_name"
    )


def comments_with_posts(t: Tables) -> DataFrame:
    comments = t["comment"].select(F.col("id").alias("comment_id"), "parent_id")
    return lookup_unwind(
        comments, t["post"].select("name", F.col("title").alias("post_title")), "parent_id", "name"
    ).select("comment_id", "post_title")


def posts_with_comments(t: Tables, posts: int | None = LOOKUP_POSTS) -> DataFrame:
    """The first posts by name, each with the bodies of all its comments; all posts if ``posts`` is None."""
    chosen = t["post"].select("id", "title", "name")
    if posts is not None:
        chosen = chosen.orderBy("name").limit(posts)
    found = array_lookup(chosen, t["comment"], "name", "link_id", value="body", row_key="id")
    return found.select("id", "title", F.col("matches").alias("num_comments"), "part", F.col("values").alias("comments"))


def top_posts(t: Tables) -> DataFrame:
    return _top(t["post"].select("name", "title", "score"), "score", TOP_POSTS, "name").select("title", "score")


def average_comments(t: Tables) -> DataFrame:
    return t["post"].agg(F.avg("num_comments").alias("avg_comments"))


def active_subreddits(t: Tables) -> DataFrame:
    counts = t["post"].groupBy("subreddit_id").agg(F.count("*").alias("post_count"))
    return _top(counts, "post_count", ACTIVE_GROUPS, "subreddit_id")


def commenters_on_top_posts(t: Tables) -> DataFrame:
    """Authors of the comments on the top posts, one row per comment."""
    top = _top(t["post"].select("name", "score"), "score", COMMENTED_POSTS, "name").select("name")
    # At most COMMENTED_POSTS rows by construction.
    comments = t["comment"].select("parent_id", "author_fullname")
    return comments.join(F.broadcast(top), F.col("parent_id") == F.col("name")).select("author_fullname")


def _most_active(posts: DataFrame) -> DataFrame:
    counts = posts.groupBy("author_fullname").agg(F.count("*").alias("n"))
    return _top(counts, "n", 1, "author_fullname").select("author_fullname")


def posts_by_most_active_author(t: Tables) -> DataFrame:
    posts = t["post"]
    top = _most_active(posts.filter(F.col("author_fullname").isNotNull()))
    return posts.filter(F.col("author_fullname") == top.scalar()).select("id", "title")


def _averages(posts: DataFrame) -> DataFrame:
    averages = posts.groupBy("subreddit_id").agg(F.avg("score").alias("avg_score"))
    return averages.filter(F.col("avg_score") > HIGH_AVERAGE)


def high_average_subreddits(t: Tables) -> DataFrame:
    """The groups with the highest average. Joining them back to their own posts would add nothing."""
    groups = _averages(t["post"]).filter(F.col("subreddit_id").isNotNull())
    return _top(groups, "avg_score", HIGH_AVERAGE_GROUPS, "subreddit_id").select("subreddit_id")


def high_average_subreddits_joined(t: Tables) -> DataFrame:
    """Same result read off the posts of those groups: semi join, then distinct."""
    groups = _top(_averages(t["post"]), "avg_score", HIGH_AVERAGE_GROUPS, "subreddit_id").select("subreddit_id")
    return t["post"].select("subreddit_id").join(F.broadcast(groups), "subreddit_id", "left_semi").distinct()


def _document_authors(t: Tables) -> DataFrame:
    return t["post"].select("author_fullname", "author")


def _document_top_commenters(t: Tables) -> DataFrame:
    top = _top(t["post"].select("name", "score"), "score", 1, "name").select("name")
    return t["comment"].filter(F.col("link_id") == top.scalar()).select("author_fullname")


def _document_most_active(t: Tables) -> DataFrame:
    top = _most_active(t["post"])
    return t["post"].filter(F.col("author_fullname").eqNullSafe(top.scalar())).select("id", "title")


def _document_high_average(t: Tables) -> DataFrame:
    return _averages(t["post"]).select("subreddit_id")


def _suite(*queries: SuiteQuery) -> dict[str, SuiteQuery]:
    return {q.name: q for q in queries}


SQL_SUITE = _suite(
    SuiteQuery(
        "simple_select_authors", "simple", ("author",), select_authors,
        "SELECT author_fullname, author FROM {author}",
    ),
    SuiteQuery(
        "simple_count_posts", "simple", ("post",), lambda t: count_rows(t["post"], "post_count"),
        "SELECT count(*) AS post_count FROM {post}",
    ),
    SuiteQuery(
        "simple_count_comments", "simple", ("comment",), lambda t: count_rows(t["comment"], "comment_count"),
        "SELECT count(*) AS comment_count FROM {comment}",
    ),
    SuiteQuery(
        "simple_unique_subreddits", "simple", ("post",), unique_subreddits,
        "SELECT DISTINCT subreddit_id FROM {post}",
    ),
    SuiteQuery(
        "select_path_content_from_wiki", "simple", ("wiki",), lambda t: t["wiki"].select("path", "content"),
        "SELECT path, content FROM {wiki}",
    ),
    SuiteQuery(
        "join_posts_with_authors", "join", ("post", "author"), posts_with_authors,
        """SELECT p.id, p.title, a.author
           FROM {post} AS p JOIN {author} AS a USING (author_fullname)""",
    ),
    SuiteQuery(
        "join_posts_with_subreddits", "join", ("post", "subreddit"), posts_with_subreddits,
        """SELECT p.id, p.title, s.display_name
           FROM {post} AS p JOIN {subreddit} AS s ON s.name = p.subreddit_id""",
    ),
    SuiteQuery(
        "join_comments_with_posts", "join", ("comment", "post"), comments_with_posts,
        """SELECT c.id AS comment_id, p.title AS post_title
           FROM {comment} AS c JOIN {post} AS p ON p.name = c.parent_id""",
    ),
    SuiteQuery(
        "analytical_top_posts_by_score", "analytical", ("post",), top_posts,
        f"SELECT title, score FROM {{post}} ORDER BY score DESC NULLS LAST, name LIMIT {TOP_POSTS}",
    ),
    SuiteQuery(
        "analytical_average_comments_per_post", "analytical", ("post",), average_comments,
        "SELECT avg(num_comments) AS avg_comments FROM {post}",
    ),
    SuiteQuery(
        "analytical_active_subreddits_by_post_count", "analytical", ("post",), active_subreddits,
        f"""SELECT subreddit_id, count(*) AS post_count FROM {{post}}
            GROUP BY subreddit_id ORDER BY post_count DESC, subreddit_id NULLS LAST LIMIT {ACTIVE_GROUPS}""",
    ),
    SuiteQuery(
        "nested_top_commenters_on_top_post", "nested", ("comment", "post"), commenters_on_top_posts,
        f"""WITH top AS (SELECT name FROM {{post}} ORDER BY score DESC NULLS LAST, name LIMIT {COMMENTED_POSTS})
            SELECT c.author_fullname FROM {{comment}} AS c JOIN top ON top.name = c.parent_id""",
    ),
    SuiteQuery(
        "nested_posts_by_most_active_author", "nested", ("post",), posts_by_most_active_author,
        """SELECT id, title FROM {post}
           WHERE author_fullname = (
             SELECT author_fullname FROM {post} WHERE author_fullname IS NOT NULL
             GROUP BY author_fullname ORDER BY count(*) DESC, author_fullname LIMIT 1)""",
    ),
    SuiteQuery(
        "nested_subreddits_with_high_avg_score", "nested", ("post",), high_average_subreddits,
        f"""WITH average AS (SELECT subreddit_id, avg(score) AS score FROM {{post}} GROUP BY subreddit_id),
            high AS (SELECT subreddit_id FROM average WHERE score > {HIGH_AVERAGE}
                     ORDER BY score DESC, subreddit_id LIMIT {HIGH_AVERAGE_GROUPS})
            SELECT DISTINCT p.subreddit_id FROM {{post}} AS p LEFT SEMI JOIN high ON high.subreddit_id = p.subreddit_id""",
    ),
)

DOCUMENT_SUITE = _suite(
    SuiteQuery(
        "simple_select_authors", "simple", ("post",), _document_authors,
        note="read from posts, so one row per post",
    ),
    SuiteQuery("simple_count_posts", "simple", ("post",), lambda t: count_rows(t["post"], "post_count")),
    SuiteQuery("simple_unique_subreddits", "simple", ("post",), unique_subreddits),
    SuiteQuery(
        "join_posts_with_comments", "join", ("post", "comment"), posts_with_comments,
        note="array of comment bodies per post; a post without comments has an empty array",
    ),
    SuiteQuery("join_posts_with_subreddits", "join", ("post", "subreddit"), posts_with_subreddits),
    SuiteQuery("join_comments_with_posts", "join", ("comment", "post"), comments_with_posts),
    SuiteQuery("analytical_top_posts_by_score", "analytical", ("post",), top_posts),
    SuiteQuery("analytical_average_comments_per_post", "analytical", ("post",), average_comments),
    SuiteQuery("analytical_active_subreddits_by_post_count", "analytical", ("post",), active_subreddits),
    SuiteQuery(
        "nested_top_commenters_on_top_post", "nested", ("comment", "post"), _document_top_commenters,
        note="the one top post, matched on link_id",
    ),
    SuiteQuery(
        "nested_posts_by_most_active_author", "nested", ("post",), _document_most_active,
        note="a missing author counts as a value",
    ),
    SuiteQuery(
        "nested_subreddits_with_high_avg_score", "nested", ("post",), _document_high_average,
        note="all groups over the threshold",
    ),
)


def document_table(documents: DataFrame, ddl: str) -> DataFrame:
    """Typed columns out of the VARIANT documents of a collection, so a suite query can read them."""
    fields = [f.strip().split(" ") for f in ddl.split(",")]
    return documents.select(*[F.expr(f"try_variant_get(doc, '$.{n}', '{t}')").alias(n) for n, t in fields])
