"""The driver tables in the roles of archive tables and dump lines.

Orders play posts, customers play authors and communities, line items play comments, pages play wiki
pages, documents carry rules (one per text line), events play records of open schema.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.plans.suite import document_table
from threadloom.session import scratch_path
from threadloom.sinks.tables import append_load, with_key_layout


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tagged(tag: str, column: str) -> Column:
    return F.concat(F.lit(tag), F.col(column).cast("string"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        _tagged("t3_", "o_orderkey").alias("name"),
        F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("title"),
        F.when(F.col("o_orderstatus") != "P", _tagged("t2_", "o_custkey")).alias("author_fullname"),
        _tagged("user_", "o_custkey").alias("author"),
        _tagged("t5_", "o_custkey").alias("subreddit_id"),
        F.floor(F.col("o_totalprice") / 300).alias("score"),
        F.floor(F.col("o_totalprice") / 10000).alias("num_comments"),
    )


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a debt have a key that no post has."""
    key = F.when(F.col("c_acctbal") >= 0, _tagged("t2_", "c_custkey")).otherwise(_tagged("x2_", "c_custkey"))
    return table(spark, sf_dir, "customer").select(key.alias("author_fullname"), F.col("c_name").alias("author"))


def subreddits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one segment have a name that no post has."""
    return table(spark, sf_dir, "customer").select(
        F.when(F.col("c_mktsegment") != "MACHINERY", _tagged("t5_", "c_custkey")).otherwise(_tagged("x5_", "c_custkey")).alias("name"),
        F.concat_ws("_", "c_mktsegment", F.col("c_custkey").cast("string")).alias("display_name"),
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line items answer the post, later ones answer a comment below the same post."""
    number = F.col("l_linenumber").cast("string")
    key = F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), number)
    return table(spark, sf_dir, "lineitem").select(
        key.alias("id"),
        _tagged("t3_", "l_orderkey").alias("link_id"),
        F.when(F.col("l_linenumber") == 1, _tagged("t3_", "l_orderkey"))
        .otherwise(_tagged("t1_", "l_orderkey"))
        .alias("parent_id"),
        _tagged("t2_", "l_suppkey").alias("author_fullname"),
        F.concat("l_returnflag", "l_linestatus", F.col("l_partkey").cast("string")).alias("body"),
    )


def wikis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.col("html").alias("content"))


TABLES = {"post": posts, "author": authors, "subreddit": subreddits, "comment": comments, "wiki": wikis}


def archive(spark: SparkSession, sf_dir: str, names: Iterable[str] = tuple(TABLES)) -> dict[str, DataFrame]:
    """The tables the suite reads."""
    return {name: TABLES[name](spark, sf_dir) for name in names}


_COLLECTIONS: dict[tuple[str, str, str], str] = {}


def document_archive(spark: SparkSession, sf_dir: str, names: Iterable[str] = tuple(TABLES)) -> dict[str, DataFrame]:
    """The same tables read out of stored VARIANT documents. A collection is written once for each Spark application."""
    found = {}
    for name in names:
        rows = TABLES[name](spark, sf_dir)
        at = (spark.sparkContext.applicationId, sf_dir, name)
        if at not in _COLLECTIONS:
            path = scratch_path(spark, f"collection-{name}")
            key = rows.columns[0]
            # Rows are laid out before they become documents, which are several times as long and carry every field name.
            laid_out = with_key_layout(rows, [key])
            append_load(laid_out.select(key, F.parse_json(F.to_json(F.struct(*rows.columns))).alias("doc")), path, "standin")
            _COLLECTIONS[at] = path
        ddl = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
        found[name] = document_table(spark.read.parquet(_COLLECTIONS[at]), ddl)
    return found


def _line(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _placed(df: DataFrame, line: Column, order: str) -> DataFrame:
    """Lines with the place columns of a file scan; ``order`` is the line order."""
    return df.select(
        line.alias("value"), F.lit("dump").alias("file_path"), F.lit(0).cast("bigint").alias("block_start"),
        F.col(order).cast("bigint").alias("row_id"),
    )


def _in_order(df: DataFrame, order: str) -> DataFrame:
    return df.repartitionByRange(order).sortWithinPartitions(order)


def submission_lines(spark: SparkSession, sf_dir: str, in_order: bool = False) -> DataFrame:
    """Raw post records. ``edited`` takes every form found in dumps, by order priority. ``in_order``: laid out in line order, before
    the rows become lines."""
    edited = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.parse_json(F.lit("false")))
        .when(F.col("o_orderpriority") == "2-HIGH", F.parse_json(F.lit("true")))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.parse_json(F.lit("0")))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.parse_json(F.lit("1735689600.5")))
    )
    pending = F.col("o_orderstatus") == "P"
    line = _line(
        F.col("o_orderkey").cast("string").alias("id"),
        _tagged("t3_", "o_orderkey").alias("name"),
        F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("title"),
        F.concat(F.lit(" User_"), F.col("o_custkey").cast("string"), F.lit("\t")).alias("author"),
        F.when(~pending, _tagged("t2_", "o_custkey")).alias("author_fullname"),
        (F.col("o_orderstatus") == "F").alias("author_premium"),
        F.floor(F.col("o_totalprice") / 300).alias("score"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("created_utc"),
        edited.alias("edited"),
        F.when(pending, F.lit("moderator")).alias("distinguished"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("spam")).alias("removal_reason"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("moderator")).alias("removed_by"),
        F.array(F.col("o_orderpriority")).alias("content_categories"),
        F.lit(0.5).alias("not_in_the_table"),
    )
    orders = table(spark, sf_dir, "orders")
    return _placed(_in_order(orders, "o_orderkey") if in_order else orders, line, "o_orderkey")


def comment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("_", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    line = _line(
        key.alias("id"),
        _tagged("t3_", "l_orderkey").alias("link_id"),
        F.when(F.col("l_returnflag") == "R", F.lit("low score")).alias("collapsed_reason"),
        F.when(F.col("l_returnflag") == "R", F.lit("LOW_SCORE")).alias("collapsed_reason_code"),
        _tagged("t2_", "l_suppkey").alias("author_fullname"),
        F.when(F.col("l_linestatus") == "F", F.lit("moderator")).alias("distinguished"),
        F.lit(False).alias("edited"),
    )
    return _placed(items, line, "l_orderkey")


def rule_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a community, each line of its text is a rule; French ones have no short name."""
    rules = F.transform(
        F.split("text", "\n", -1),
        lambda text, i: F.struct(
            i.alias("priority"),
            F.when(F.col("lang") != "fr", F.col("lang")).alias("short_name"),
            text.alias("description"),
            F.col("source").alias("kind"),
        ),
    )
    documents = table(spark, sf_dir, "documents")
    return _placed(documents, _line(_tagged("doc_", "doc_id").alias("subreddit"), rules.alias("rules")), "doc_id")


def wiki_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with an English path belong to a community; pages with a referrer have an unreadable date."""
    moment = F.timestamp_seconds(F.lit(1735689600) + F.col("page_id") * 3600)
    date = F.when(F.contains("url", F.lit("ref=")), F.lit("unknown")).otherwise(
        F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    )
    line = _line(
        F.replace("url", F.lit("/en/"), F.lit("/r/en_wiki/")).alias("path"),
        F.col("html").alias("content"),
        F.col("page_id").alias("retrieved_on"),
        date.alias("revision_date"),
    )
    return _placed(table(spark, sf_dir, "pages"), line, "page_id")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of open schema: a field missing in clicks, nested objects, arrays, an unreported branch."""
    kind = F.col("event_type")
    line = F.to_json(
        F.struct(
            F.col("event_id"),
            F.when(kind != "click", kind).alias("event_type"),
            F.struct(
                F.col("user_id").alias("id"),
                F.struct(F.when(kind == "error", F.col("props")).alias("props")).alias("device"),
            ).alias("user"),
            F.array(F.struct(kind.alias("tag")), F.struct(F.when(kind == "view", kind).alias("tag"))).alias("tags"),
            F.struct(F.struct(kind.alias("tag")).alias("inner")).alias("preview"),
        )
    )
    return _placed(table(spark, sf_dir, "events"), line, "event_id")


def write_event_dump(spark: SparkSession, sf_dir: str, files: int | None = None) -> str:
    """Events as an NDJSON dump in event order over several files; returns the folder."""
    path = scratch_path(spark, "events-dump")
    events = table(spark, sf_dir, "events").select(
        F.to_json(F.struct("event_id", "user_id", "event_type", "props")).alias("value"), "event_id"
    )
    ranged = events.repartitionByRange(files, "event_id") if files else events.repartitionByRange("event_id")
    ranged.sortWithinPartitions("event_id").select("value").write.text(path)
    return path


def write_plain_dump(lines: DataFrame, label: str) -> str:
    """Lines as files without an extension, as dumps are published; returns the folder."""
    path = scratch_path(lines.sparkSession, label)
    lines.rdd.map(lambda r: r["value"]).saveAsTextFile(path)
    return path


def write_dump(lines: DataFrame, label: str, in_order: bool = False) -> str:
    """Lines as an NDJSON dump in line order, which they are in already if ``in_order``; returns the folder."""
    path = scratch_path(lines.sparkSession, label)
    (lines if in_order else _in_order(lines, "row_id")).select("value").write.text(path)
    return path


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as recorded query runs; one system lacks one query."""
    items = table(spark, sf_dir, "lineitem")
    query = F.concat_ws("_", "l_returnflag", "l_linestatus")
    system = _tagged("sys", "l_linenumber")
    lacks = (system == "sys7") & (query == "R_F")
    return items.filter(~lacks).select(
        system.alias("system"),
        query.alias("query"),
        F.col("l_extendedprice").alias("time"),
        F.col("l_quantity").alias("memory"),
        F.when(F.col("l_returnflag") == "A", F.lit(1))
        .when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 1), F.floor("l_quantity") + 100)
        .otherwise(F.floor("l_quantity"))
        .cast("bigint")
        .alias("output_length"),
    )


SYSTEMS = tuple(f"sys{i}" for i in range(1, 8))


def loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as load summaries of three systems."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("system"),
        F.concat(F.lit("data/dump/"), F.replace("o_orderpriority", F.lit(" "), F.lit("_"))).alias("data_file"),
        F.col("o_custkey").alias("time_elapsed_seconds"),
        F.floor(F.col("o_totalprice")).cast("bigint").alias("line_count"),
    )


LOAD_SYSTEMS = ("F", "O", "P")
LOAD_FILES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT_SPECIFIED", "5-LOW")
