"""The training corpus from ``documents``: five stages, each over all that the one before it kept.

A document is named by its doc_id together with its text. Rows that repeat both are one document and share its fate; rows that
repeat the doc_id alone are different documents. A row without doc_id is a document by all its columns, so that only rows equal
in every column are one.

Every stage takes the columns of ``documents`` (null text is empty text, repeated rows and extra columns stay) and, but for
the last, returns them. The order is: toxic documents go, documents without a recognised language go, one document of
each group of near copies stays, documents that hold benchmark items go, and what is left is encoded.
"""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import bpe, decontaminate, language, ngram_join, toxicity
from threadloom.llm.common import table, written
from threadloom.llm.queries import PIECES, TOKENIZER
from threadloom.session import scratch_path

# Share of probability that a document's best language needs.
LEAST_LANGUAGE_SCORE = 0.5

# Rows and bytes sent to Python at a time while the stages run: what an executor holds outside its heap grows with them.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 * 1024**2)}

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """``stage`` with the settings ``BATCHES`` where the session has none of its own. They outlast the call, as what a stage returns
    is computed later."""

    @functools.wraps(stage)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, value in BATCHES.items():
            if spark.conf.get(name, None) is None:
                spark.conf.set(name, value)
        return stage(spark, docs, sf_dir)

    return call


def text_and_row(docs: DataFrame) -> DataFrame:
    """The text, and all other columns in one, so that none clashes with what an operator adds and no text goes to Python twice."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select("text", (F.struct(*others) if others else F.lit(None).cast("struct<none: int>")).alias("row"))


def with_row(scored: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again."""
    return scored.select(*["text" if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return with_row(toxicity.score(text_and_row(docs), model).filter("predicted = 0"), docs)


@in_small_batches
def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model recognises; text without letters has none."""
    model = language.train(docs, PIECES)
    scored = language.predict(text_and_row(docs), model)
    return with_row(scored.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)), docs)


def with_key(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row_key``, never null: a 64-bit hash that names the document a row belongs to."""
    by_id = F.xxhash64(F.lit(1), "doc_id", F.coalesce("text", F.lit("")))
    by_row = F.xxhash64(F.lit(0), F.to_json(F.struct(*docs.columns)))
    return docs.withColumn("row_key", F.when(F.col("doc_id").isNotNull(), by_id).otherwise(by_row))


@in_small_batches
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies, one without id only where all are; documents without
    words are in no group."""
    keyed = with_key(docs)
    groups = ngram_join.mark_groups(keyed, "row_key").select(F.col("doc_id").alias("row_key"), F.col("component_id").alias("group")).distinct()
    named = groups.join(keyed.select("row_key", "doc_id").distinct(), "row_key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key"))
    kept = named.groupBy("group").agg(first.alias("first")).select("first.row_key")
    return keyed.join(kept, "row_key", "left_semi").select(docs.columns)


@in_small_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    keyed = with_key(docs)
    named = keyed.select(F.col("row_key").alias("doc_id"), "text")
    leaks = decontaminate.find(named, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("row_key")).distinct()
    return keyed.join(leaks, "row_key", "left_anti").select(docs.columns)


@in_small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digest of the text decoded from them."""
    # Written in between, so that a task has one Python worker at a time.
    encoded = written(bpe.encode_texts(docs.select("doc_id", "text", "lang", "source"), TOKENIZER).drop("text"), "encoded")
    decoded = bpe.decode_ids(encoded, TOKENIZER, after_encoding=True)
    return decoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("language", keep_known_language),
    ("near_copies", keep_one_of_each_group),
    ("benchmark", drop_contaminated),
    ("encoding", encode),
]

# Trained models, shingle sets over all pairs and byte-level BPE have no SQL form; tests hold the stages against
# brute-force versions instead.
ORACLE_SQL: str | None = None

@contextlib.contextmanager
def small_arrow_batches(spark: SparkSession) -> Iterator[None]:
    """The settings ``BATCHES`` while the stages run; the session's own come back afterwards."""
    before = {name: spark.conf.get(name, None) for name in BATCHES}
    try:
        for name, value in BATCHES.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    with small_arrow_batches(spark):
        for name, stage in STAGES:
            path = scratch_path(spark, f"pipeline-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
