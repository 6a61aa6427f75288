"""Registered queries of the operators, each over its whole table, and their SQL counterparts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import bpe, byte_bpe, collocations, decontaminate, forest, hilbert, html_text, language, licenses, ngram_join, periodic, token_store, toxicity
from threadloom.llm.common import map_arrow, table, with_columns
from threadloom.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

PIECES = public_tokenizers.path("piece_bpe_32k.model")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKED_TOKENS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
END_ID = 2


def registered(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return add


@registered("op1_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_texts(table(spark, sf_dir, "documents", "doc_id", "text"), TOKENIZER).drop("text")
    digests = encoded.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256")
    )
    decoded = bpe.decode_ids(digests, TOKENIZER)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@registered("op2_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("spans").alias("n_spans"))


@registered("op3_main_text")
def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


@registered("op4_token_store")
def token_store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents", "doc_id", "text"), target, TOKENIZER, END_ID)
    return token_store.documents_of(token_store.read_store(spark, target))


def held_out() -> Column:
    """Whether a document is kept back from learning; one without id is neither kept back nor learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


@registered("op5_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


@registered("op6_ngram_jaccard")
def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.mark_groups(table(spark, sf_dir, "documents", "doc_id", "text"))


@registered("op7_vector_forest")
def vector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.link_vectors(table(spark, sf_dir, "embeddings"))


@registered("op8_language")
def language_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language.train(documents, PIECES)
    return language.predict(documents.drop("lang"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@registered("op9_hilbert_shards")
def hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = hilbert.document_metadata(table(spark, sf_dir, "documents"))
    placed = hilbert.assign_shards(meta, hilbert.document_place(meta), ["doc_id", "text_crc32", "size"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@registered("op10_benchmark_leaks")
def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


COLLOCATIONS_SQL = r"""
WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
    WHERE text IS NOT NULL),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
counts AS (
    SELECT lang, phrase, size, count(*) AS f FROM (
        SELECT lang, 1 AS size, unnest(w) AS phrase FROM words
        UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
        UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words)
    GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE size = 1 GROUP BY 1),
candidates AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= 10),
cuts AS (
    SELECT lang, phrase, a, w, 1 AS k, w[1] AS p, array_to_string(w[2:], ' ') AS q FROM candidates
    UNION ALL SELECT lang, phrase, a, w, 2, w[1] || ' ' || w[2], w[3] FROM candidates WHERE size = 3),
scored AS (
    SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r,
           CAST(1000000 * CAST(c.a AS HUGEINT) * c.a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
    FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.p JOIN counts y ON y.lang = c.lang AND y.phrase = c.q),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (
    SELECT lang, phrase, max(a) AS longer FROM (
        SELECT lang, a, w[1] || ' ' || w[2] AS phrase FROM candidates WHERE size = 3
        UNION ALL SELECT lang, a, w[2] || ' ' || w[3] FROM candidates WHERE size = 3) GROUP BY 1, 2),
kept AS (
    SELECT b.* FROM best b LEFT JOIN inner_phrases i ON i.lang = b.lang AND i.phrase = b.phrase
    WHERE NOT coalesce(100 * i.longer >= 50 * b.a, false)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@registered("op11_phrase_collocations", COLLOCATIONS_SQL)
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents", "text", "lang")).drop("cut")


def digested_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """With ``n_tokens`` and the digest of the ids as little-endian unsigned 32-bit integers."""
    for batch in batches:
        ids = batch.column("ids")
        lengths = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat, ends = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.cumsum(lengths)
        digests = [hashlib.sha256(flat[e - n : e].tobytes()).hexdigest() for e, n in zip(ends, lengths, strict=True)]
        yield with_columns(batch, n_tokens=pa.array(lengths), ids_sha256=pa.array(digests, pa.string()))


@registered("op12_byte_bpe")
def byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode_texts(table(spark, sf_dir, "documents", "doc_id", "text"), RANKED_TOKENS, public_tokenizers.PATTERN)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Digest and decoding in one worker.
        yield from byte_bpe.decoded_batches(digested_batches(batches), RANKED_TOKENS)

    decoded = map_arrow(encoded, rows, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded binary")
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def with_planted_period(text: Column, doc_id: Column) -> Column:
    """The words of a text, joined by blanks; in every tenth document by checksum they repeat with a period from some word on."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n, h = F.size(words), F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    block = F.slice(words, a + 1, p)
    repeated = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), a), repeated), " ")
    return F.when((h % 10 == 0) & (n > 0), planted).otherwise(text)


@registered("op13_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    found = periodic.find_runs(documents.withColumn("text", with_planted_period(F.col("text"), F.col("doc_id"))))
    best = periodic.longest_run("runs")
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(listed, "\n"), F.lit("\n"))).otherwise("")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256",
    )
