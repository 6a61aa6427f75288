"""Phrases of two or three words that stand together more often than their parts let expect, for each language, mined by partitions.

The corpus is split into a few shards by a hash of the text, each spread over many tasks. A shard is mined completely at a local
support lowered in proportion to its share of the text: a phrase that reaches the global support must reach its proportion of
it in one shard at least, as the shares add up to one. Mining goes by 64-bit hashes of language and words, of which every task sends each once with its count, so
the shuffle holds no text; two phrases with one hash only make both candidates. The union of the locally frequent hashes is marked in a
bit table of bounded size. A second scan counts every phrase that hits it, this time by its words, so the counts are exact whatever
the table lets through, and the global support decides.

Words lie between blanks and tabs inside pieces, which end at punctuation and line ends; A to Z are lower-cased first.

Defined cases: null and empty texts have no words; a null language is ``und``; repeated rows count as often as they occur; a text is taken
whole, whatever its length; ties are broken by count, then by the bytes of the phrase; an empty table gives an empty one; columns
beside text and language are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import byte_slices, drop_held, give_back, map_arrow, partition_count, send_package, small_batches, written

# The punctuation and line ends that phrases do not cross.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
UNKNOWN = "und"

LONGEST = 3
SHARDS = 3
# Text handled at a time: much where its distinct hashes are sent, so that they are few; less where phrases are counted, which
# tasks add up before the shuffle anyway.
SLICE_BYTES = 24 * 1024**2
COUNTED_BYTES = 8 * 1024**2
# Rows that a worker hands out at a time.
SENT_ROWS = 1 << 17
# Input bytes for a task that sums hashes: they come to about a quarter of a million words and a million hashes.
HASH_TASK_BYTES = 4 * 1024**2

# Bits of the candidate table for each candidate, and its greatest size of 32 MiB. Beyond, more phrases pass it and are counted.
BITS_EACH = 16
LEAST_BITS, MOST_BITS = 20, 28
SEGMENT_BITS = 20

# First ranking step: so many groups of each language are ranked on their own.
RANK_GROUPS = (4096, 64)

_END = b"\xff"  # stands for the end of a piece: no byte of UTF-8
_TO = bytes(0xFF if c in PIECE_ENDS else c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Chunk:
    """Words of some texts as numbers, one sequence for each group; number 0 ends a piece."""

    def __init__(self, texts: Iterable[bytes | None], groups: Iterable):
        number: dict[bytes, int] = defaultdict(count(1).__next__)
        parts = defaultdict(list)
        for text, group in zip(texts, groups, strict=True):
            if text:
                words = text.translate(_TO).replace(_END, b" \xff ").split()
                parts[group].append(np.fromiter((0 if w == _END else number[w] for w in words), np.int32, len(words)))
        self.words = [_END, *number]
        del number
        self.sequences = {g: np.concatenate([x for p in parts.pop(g) for x in (p, _ZERO)]) for g in list(parts)}
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.words), np.uint64, len(self.words))

    def phrases(self, group, size: int) -> list[np.ndarray]:
        """The numbers of the first, second, ... words of all phrases of a size."""
        sequence = self.sequences[group]
        columns = [sequence[i : len(sequence) - size + 1 + i] for i in range(size)]
        whole = columns[0] > 0
        for column in columns[1:]:
            whole &= column > 0
        return [c[whole] for c in columns]

    def phrase_hashes(self, columns: list[np.ndarray], lang: str) -> np.ndarray:
        """Hashes of phrases; those of unlike sizes or languages start from unlike values."""
        value = np.full(len(columns[0]), xxhash.xxh3_64_intdigest(lang, seed=len(columns)), np.uint64)
        for column in columns:
            value ^= self.hashes[column]
            value *= _MIX
            value ^= value >> np.uint64(29)
        return value


_ZERO = np.zeros(1, dtype=np.int32)


def _chunks(batches: Iterator[pa.RecordBatch], groups: list[str], most: int) -> Iterator[Chunk]:
    """Chunks of at most ``most`` bytes of text, or of one longer text; only the one handed out is held."""
    for batch in byte_slices(batches, "text", most):
        rows = list(small_batches(iter([batch])))
        texts = (t for r in rows for t in r.column("text").cast(pa.binary()).to_pylist())
        yield Chunk(texts, (k for r in rows for k in zip(*[r.column(g).to_pylist() for g in groups], strict=True)))


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values and how often each occurs; ``values`` is sorted in place, so that no copy is held beside it."""
    values.sort()
    starts = np.flatnonzero(values[1:] != values[:-1]) + 1
    starts = np.concatenate([np.zeros(min(1, len(values)), dtype=np.int64), starts])
    return values[starts], np.diff(starts, append=len(values))


def local_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, hash, times) of all phrases of one to three words in each chunk."""
    drop_held()
    for chunk in _chunks(batches, ["lang", "shard"], SLICE_BYTES):
        for (lang, shard), size in ((g, s) for g in chunk.sequences for s in range(1, LONGEST + 1)):
            found, times = _counted(chunk.phrase_hashes(chunk.phrases((lang, shard), size), lang))
            for at in range(0, len(found), SENT_ROWS):
                part = slice(at, at + SENT_ROWS)
                shards = pa.array(np.full(len(found[part]), shard, np.int32))
                yield pa.RecordBatch.from_arrays([shards, pa.array(found[part].view(np.int64)), pa.array(times[part])], names=["shard", "hash", "times"])
            del found, times
        del chunk
    give_back()


def candidate_hashes(df: DataFrame, support: int, shards: int) -> DataFrame:
    """Hashes of the phrases that are frequent in some shard; ``df`` has ``text, lang, shard``."""
    sizes = df.groupBy("shard").agg(F.sum(F.octet_length("text") + 1).alias("size")).collect()  # one row for each of a few shards
    total = sum(r["size"] or 0 for r in sizes)
    least = F.lit(0)
    for r in sizes:
        # times / support >= size / total, in whole numbers
        least = F.when(F.col("shard") == r["shard"], F.lit(-(-support * (r["size"] or 0) // max(1, total)))).otherwise(least)
    sent = map_arrow(df, local_hashes, "shard int, hash bigint, times bigint")
    # Almost every hash of a task is new to it, so that nothing would be saved by adding up before the shuffle.
    dealt = sent.repartition(partition_count(df, HASH_TASK_BYTES), "shard", "hash")
    return dealt.groupBy("shard", "hash").agg(F.sum("times").alias("times")).filter(F.col("times") >= least).select("hash")


def bit_table(candidates: DataFrame) -> bytes:
    """Bit table of hashes, at most 32 MiB: the leading bits of a hash give its place.

    Its segments are made on the executors.
    """
    candidates = written(candidates, "candidates")
    bits = min(MOST_BITS, max(LEAST_BITS, int(candidates.count() * BITS_EACH).bit_length()))

    def segment(key: tuple, rows: pa.Table) -> pa.Table:
        at = np.concatenate([np.zeros(0, np.int64), *[c.to_numpy() for c in rows.column("place").chunks]])
        table = np.zeros(1 << SEGMENT_BITS, dtype=np.uint8)
        table[at & ((1 << SEGMENT_BITS) - 1)] = 1
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(table).tobytes()], pa.binary())})

    place = F.shiftrightunsigned("hash", 64 - bits)
    send_package(candidates.sparkSession)
    placed = candidates.select(place.alias("place"), F.shiftright(place, SEGMENT_BITS).alias("segment")).distinct()
    made = placed.groupBy("segment").applyInArrow(segment, "segment bigint, bits binary").collect()
    size = 1 << (SEGMENT_BITS - 3)
    table = bytearray(size << (bits - SEGMENT_BITS))
    for r in made:
        table[r["segment"] * size : (r["segment"] + 1) * size] = r["bits"]
    return bytes(table)


def known_phrases(batches: Iterator[pa.RecordBatch], table: bytes, most: int = COUNTED_BYTES) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, times) of the phrases in each chunk that the bit table knows, and with null for phrase the number of words."""
    drop_held()
    marked, bits = np.frombuffer(table, np.uint8), (len(table) * 8).bit_length() - 1

    def counted(lang: str, phrases: list, times: np.ndarray) -> pa.RecordBatch:
        text = pa.array(phrases, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), text, pa.array(times)], names=["lang", "phrase", "times"])

    def found_in(chunk: Chunk, lang: str, size: int) -> Iterator[pa.RecordBatch]:
        words, columns = chunk.words, chunk.phrases((lang,), size)
        if size == 1:
            yield counted(lang, [None], np.array([len(columns[0])], dtype=np.int64))
        place = chunk.phrase_hashes(columns, lang) >> np.uint64(64 - bits)
        hit = (marked[place >> np.uint64(3)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8))) & 1
        columns = [c[hit == 1] for c in columns]
        del place, hit
        # Equal phrases have equal numbers, so these are added up without a hash.
        key, keys = columns[0].astype(np.int64), []
        for column in columns[1:]:
            known, key = np.unique(key, return_inverse=True)
            keys.append(known)
            key = key * len(words) + column
        found, times = _counted(key)
        parts, rest = [], found
        for known in reversed(keys):
            parts.append(rest % len(words))
            rest = known[rest // len(words)]
        parts.append(rest)
        phrases = [b" ".join([words[i] for i in p]) for p in zip(*[p.tolist() for p in reversed(parts)], strict=True)]
        yield counted(lang, phrases, times)

    for chunk in _chunks(batches, ["lang"], most):
        for (lang,), size in ((g, s) for g in chunk.sequences for s in range(1, LONGEST + 1)):
            yield from found_in(chunk, lang, size)
        del chunk
    give_back()


def phrase_counts(df: DataFrame, table: bytes) -> DataFrame:
    """(lang, phrase, times) of all phrases the bit table knows, and for each language, with null for phrase, the number of its words."""
    shared = df.sparkSession.sparkContext.broadcast(table)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from known_phrases(batches, shared.value)

    return map_arrow(df, rows, "lang string, phrase string, times bigint").groupBy("lang", "phrase").agg(F.sum("times").alias("times"))


def exact_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (l * r)) in whole numbers of up to 38 digits."""
    wide = "decimal(19,0)"
    million = F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", million * a.cast("decimal(15,0)") * a.cast("decimal(15,0)"), left.cast(wide) * right.cast(wide))


def mine(
    df: DataFrame, text: str = "text", lang: str = "lang", support: int = 10, cover_percent: int = 50, top: int = 2000, shards: int = SHARDS
) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score, cut``.

    ``a`` is the number of occurrences, ``l`` and ``r`` those of the two parts at the cut (after ``cut`` words) with the
    lowest score, ``n`` the words of the language. A phrase inside a longer one with at least ``cover_percent`` of its occurrences is left out.
    """
    texts = df.select(F.col(f"`{text}`").alias("text"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"))
    shard = F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int").alias("shard")
    table = bit_table(candidate_hashes(texts.select("text", "lang", shard), support, shards))
    counts = phrase_counts(texts, table)
    counts = written(counts.filter((F.col("times") >= support) | F.col("phrase").isNull()), "phrases")
    totals = counts.filter(F.col("phrase").isNull()).select("lang", F.col("times").alias("n"))
    known = counts.filter(F.col("phrase").isNotNull())
    words = F.split("phrase", " ")
    phrases = known.withColumn("words", words).filter(F.size("words") >= 2).withColumnRenamed("times", "a")

    # Every part of a frequent phrase is frequent itself, so each finds its count.
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.array(
        F.struct(k.alias("k"), F.lit("l").alias("side"), F.array_join(F.slice("words", F.lit(1), k), " ").alias("part")),
        F.struct(k.alias("k"), F.lit("r").alias("side"), F.array_join(F.slice("words", k + 1, F.size("words")), " ").alias("part")),
    )))
    parts = phrases.select("lang", "phrase", "a", F.inline(pieces))
    joined = parts.join(known.select("lang", F.col("phrase").alias("part"), "times"), ["lang", "part"])

    def of(k: int, side: str) -> Column:
        return F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("times"))).alias(f"{side}{k}")

    cuts = [F.struct(exact_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("cut"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, LONGEST)]
    scored = joined.groupBy("lang", "phrase", "a").agg(*[of(k, s) for k in range(1, LONGEST) for s in "lr"])
    best = F.array_min(F.filter(F.array(*cuts), lambda c: c["score"].isNotNull()))
    scored = scored.select("lang", "phrase", "a", best.alias("best")).select("lang", "phrase", "a", "best.*")
    inner = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda s: F.transform(
        F.sequence(F.lit(1), F.size("words") - s + 1), lambda i: F.array_join(F.slice("words", i, s), " ")
    ))))
    longer = phrases.filter(F.size("words") > 2).select("lang", "a", F.explode(inner).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    covered = F.coalesce(100 * F.col("longer") >= cover_percent * F.col("a"), F.lit(False))
    scored = scored.join(longer, ["lang", "phrase"], "left").filter(~covered).drop("longer")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Ranked first in many groups of a language, of which each keeps its best, so that no task ranks a language.
    for groups in (*RANK_GROUPS, 1):
        window = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(groups))).orderBy(*order)
        scored = scored.withColumn("rank", F.row_number().over(window).cast("bigint")).filter(F.col("rank") <= top)
    return scored.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")
