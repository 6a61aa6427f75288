"""Join of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and the groups they form.

Texts with equal sets are one class, found by the set's fingerprint; everything after works on classes. Two
sets that similar share a token among the first of each, in any order that is the same for all sets (the first
``n - ceil(0.8 n) + 1`` of ``n``). Rare tokens come first, by a table of counts of fixed size over all texts, so that
passages many texts share fall outside. The lists of sets by token are kept by size and by the token's position:
blocks of a list whose sizes cannot match, and places from where too little of the sets is left, are skipped.

Sets in one list are often near copies of each other, and then one set's answers follow from another's. Each
list has a pivot, the set that shares its first tokens with most others, and every set is first compared with the pivots it shares
most lists with. What links to a common pivot is joined already and its pairs need no comparison; and since 1 - Jaccard is a metric,
two sets whose distances to the pivot differ by more than 0.2 cannot link. Links within a group are thus not all listed, but none
between different groups is lost.

Sets near one pivot, their centre, share most tokens with each other, so the lists would pair all of them. They are joined by their
differences from the centre instead: the difference of two sets is that of their differences, and those are small and
mostly each set's own. The lists are left with pairs of sets that have different centres.

Defined cases: null and empty texts and those without words have size 0 and are linked with nothing; fewer than five
words are one shingle, the whole sequence; equal non-empty sets are linked; rows that repeat a doc_id are kept and stand in the
group of their own text; a null doc_id is never the name of a group unless all ids of the group are null. Other
columns are kept by ``mark_groups``; those named like an added one are replaced.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.common import components, drop_held, map_arrow, partition_count, send_package, small_batches, written
from threadloom.session import scratch_path

SHINGLE = 5
NUMERATOR, DENOMINATOR = 4, 5  # similarity of at least 4/5
SKETCH_BITS = 20
CELL_BITS = 23
# Pivots that a set is compared with, and the least similarity of a set to its centre.
PIVOTS = 2
CENTRED = 0.5
# Partners of a set that are compared in one place.
PARTNERS = 500
SLICE = 1 << 12
# Blocks of a list: sizes in one block differ by 1/16 at most.
BLOCK_STEP = 1 / 16
_random = np.random.default_rng(20_010)
BYTE_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
MIXERS = _random.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
WHITE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of UTF-8 text, A-Z lower-cased: sums of a random value for each byte times a power of
    its place in the word."""
    raw = LOWER[np.frombuffer(text, dtype=np.uint8)]
    white = WHITE[raw]
    starts = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    spans = np.diff(np.append(starts, len(raw)))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, spans)
    power = np.cumprod(np.full(int(spans.max()), STEP, dtype=np.uint64))
    values = BYTE_VALUES[raw[starts[0] :]] * power[place]
    values[white[starts[0] :]] = 0
    return _mixed(np.add.reduceat(values, starts - starts[0]))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``text``."""
    words = word_hashes(text.encode()) if text else np.zeros(0, dtype=np.uint64)
    if not len(words):
        return words
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    mixed = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        mixed = _mixed(mixed + words[i : n + i] * MIXERS[i])
    return np.unique(mixed)


def fingerprint(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def short(print_: bytes) -> int:
    """Short form of a fingerprint, for candidates; what it names is checked by the fingerprint itself."""
    return int.from_bytes(print_[:8], "little", signed=True)


def prefix_length(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


# ---------------------------------------------------------------- classes and token counts


def _narrow(part: np.ndarray) -> bytes:
    """A slice of the table of counts in as few bytes each as its largest count needs."""
    return part.astype(f"<u{next(w for w in (1, 2, 4, 8) if not int(part.max()) >> 8 * w)}").tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{len(raw) // SLICE}").astype(np.int64)


def _sets_and_counts(documents: DataFrame, target: str) -> None:
    """One pass over the texts: size and fingerprint of each set, and the task's token counts in slices of a table of
    fixed size, written to ``target`` by kind of row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        shift = np.uint64(64 - SKETCH_BITS)

        def batch_of(ids, sizes, prints, keys, slices, values) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.int64()), pa.array(slices, pa.int32()), pa.array(values, pa.binary())],
                names=["doc_id", "n_shingles", "print", "key", "slice", "counts"],
            )

        for batch in small_batches(batches):
            sizes, prints, cells = [], [], []
            for text in batch.column("text").to_pylist():
                shingles = shingle_set(text)
                sizes.append(len(shingles))
                prints.append(fingerprint(shingles))
                cells.append(shingles >> shift)
            n = len(sizes)
            counts += np.bincount(np.concatenate(cells).astype(np.int64), minlength=len(counts))
            yield batch_of(batch.column("doc_id").to_pylist(), sizes, prints, [p and short(p) for p in prints], [None] * n, [None] * n)
        for i in range(0, len(counts), SLICE):
            part = counts[i : i + SLICE]
            if part.any():
                yield batch_of([None], [None], [None], [None], [i // SLICE], [_narrow(part)])

    schema = "doc_id long, n_shingles long, print binary, key long, slice int, counts binary"
    out = map_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)
    out.withColumn("kind", F.when(F.col("slice").isNull(), "set").otherwise("count")).write.partitionBy("kind").parquet(target)


def _summed_counts(rows: DataFrame) -> np.ndarray:
    """The table of token counts, of fixed size whatever the input: slices are added in two steps, so that no task gets
    those of all tasks."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLICE, dtype=np.int64)
        for raw in group["counts"]:
            total += _wide(raw)
        return pd.DataFrame({"slice": [group["slice"].iloc[0]], "part": [0], "counts": [_narrow(total)]})

    schema = "slice int, part int, counts binary"
    rows = rows.select("slice", (F.abs(F.xxhash64("counts")) % 64).cast("int").alias("part"), "counts")
    send_package(rows.sparkSession)
    rows = rows.groupBy("slice", "part").applyInPandas(add, schema)
    rows = rows.groupBy("slice").applyInPandas(add, schema)
    table = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    for r in rows.collect():
        table[r.slice * SLICE : (r.slice + 1) * SLICE] = _wide(r["counts"])
    return table


def rank_levels(counts: np.ndarray) -> np.ndarray:
    """Coarse frequency of each cell of the table: 0 while its count could be that of many rare tokens."""
    mean = counts.mean()
    floor = mean + 6 * np.sqrt(mean) + 4
    return np.where(counts <= floor, 0, np.log2(np.maximum(counts, 1)) * 4).astype(np.uint8)


def in_order(shingles: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Tokens of a set in the order common to all sets: rare ones first, then by hash."""
    level = levels[(shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    return shingles[np.argsort(level, kind="stable")]


# ---------------------------------------------------------------- candidates


def _index(documents: DataFrame, levels: np.ndarray) -> DataFrame:
    """(token, key, size, place) for the first tokens of every set; repeated sets give their rows once for each task."""
    sent = documents.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in small_batches(batches):
            tokens, keys, sizes, places = [], [], [], []
            for text in batch.column("text").to_pylist():
                shingles = shingle_set(text)
                if not len(shingles) or (key := short(fingerprint(shingles))) in met:
                    continue
                if len(met) < 100_000:
                    met.add(key)
                first = in_order(shingles, sent.value)[: prefix_length(len(shingles))]
                tokens.append(first.astype(np.int64))
                keys.append(np.full(len(first), key, dtype=np.int64))
                sizes.append(np.full(len(first), len(shingles), dtype=np.int64))
                places.append(np.arange(len(first), dtype=np.int64))
            if tokens:
                columns = [pa.array(np.concatenate(c)) for c in (tokens, keys, sizes, places)]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "key", "size", "place"])

    return map_arrow(documents.select("text"), run, "token long, key long, size long, place long")


def _lists(index: DataFrame) -> DataFrame:
    """Rows of the lists that hold more than one set. The rows are sorted by token within the tasks they are dealt to and
    read as a stream of which only the last row is held, so a list may be of any length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "key", "size", "place"]
        held, held_met = None, False  # the last row, and whether its list has another one before it
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy() for c in names]
            if held is not None:
                rows = [np.concatenate([h, r]) for h, r in zip(held, rows, strict=True)]
            token, key = rows[:2]
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (key[1:] != key[:-1])])
            rows = [r[new] for r in rows]
            like_next = rows[0][1:] == rows[0][:-1]
            shared = np.concatenate([[held_met], like_next]) | np.concatenate([like_next, [False]])
            held, held_met = [r[-1:] for r in rows], bool(shared[-1])
            yield pa.RecordBatch.from_arrays([pa.array(r[:-1][shared[:-1]]) for r in rows], names=names)
        if held is not None and held_met:
            yield pa.RecordBatch.from_arrays([pa.array(r) for r in held], names=names)

    dealt = index.repartition(partition_count(index), "token").sortWithinPartitions("token", "key")
    return map_arrow(dealt, run, index.schema)


def _block(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / F.log(F.lit(1 + BLOCK_STEP)))


def _prefix_length(n: Column) -> Column:
    return n - F.ceil(n * NUMERATOR / DENOMINATOR - 1e-9) + 1


def _left(size: Column, place: Column) -> Column:
    """Tokens from the place on: no more than these can be common with another set that has this token in common first."""
    return size - place


def _needed(a: Column, b: Column) -> Column:
    return F.ceil((a + b) * NUMERATOR / (NUMERATOR + DENOMINATOR) - 1e-9)


def _enough(common: Column, a: Column, b: Column) -> Column:
    """Whether sets of sizes ``a`` and ``b`` with so many common tokens among their first can reach the similarity: what is
    common besides lies behind the first tokens of one of them."""
    behind = lambda n: F.ceil(n * NUMERATOR / DENOMINATOR - 1e-9) - 1
    return common + F.greatest(behind(a), behind(b)) >= _needed(a, b)


def _pivot_pairs(lists: DataFrame) -> DataFrame:
    """Pairs of each set with the pivots that it shares most lists with. The pivot of a list's coarse block is the set whose first
    tokens stand in the longest lists: of near copies the one with the fewest changes."""
    coarse = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(1.25)))
    rows = lists.select("token", "key", "size", coarse.alias("block"))
    members = rows.groupBy("token").agg(F.count(F.lit(1)).alias("members"))
    shared = F.sum("members") / _prefix_length(F.first("size"))
    weights = written(rows.join(members, "token").groupBy("key").agg(shared.alias("weight")), "weights")
    # Dealt by token once, for the pivots and for their join, which both read the same columns: a list has few blocks, so its rows
    # meet all its pivots and keep those of their own block and the two beside it.
    rows = rows.drop("block").join(weights, "key").repartition("token").withColumn("block", coarse)
    pivots = rows.groupBy("token", "block").agg(F.max(F.struct("weight", "key")).alias("pivot")).withColumnRenamed("block", "pivot_block")
    near = F.abs(F.col("block") - F.col("pivot_block")) <= 1
    pairs = rows.join(pivots, "token").filter(near & (F.struct("weight", "key") != F.col("pivot")))
    pairs = pairs.groupBy("pivot", F.col("key").alias("b"), "size").agg(F.count(F.lit(1)).alias("common"))
    pairs = pairs.filter((F.col("common") > 1) | (4 * F.col("common") >= _prefix_length(F.col("size"))))
    nth = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("common"), F.desc("pivot")))
    return pairs.withColumn("nth", nth).filter(F.col("nth") <= PIVOTS).select(F.col("pivot.key").alias("a"), "b")


def _centres(answers: DataFrame) -> DataFrame:
    """(key, centre): of the pivots that a set is near to, the one that most sets are near to; a pivot may be its own."""
    near = answers.filter(F.col("similarity") >= CENTRED)
    balls = near.groupBy(F.col("a").alias("centre")).agg(F.count(F.lit(1)).alias("members"))
    members = near.select(F.col("a").alias("centre"), F.col("b").alias("key")).join(balls, "centre").select("key", "members", "centre")
    members = members.union(balls.select(F.col("centre").alias("key"), "members", "centre"))
    return members.groupBy("key").agg(F.max(F.struct("members", "centre")).alias("most")).select("key", "most.centre")


def _centred_pairs(answers: DataFrame, groups: DataFrame, centres: DataFrame) -> DataFrame:
    """Pairs of different groups with one centre that can link.

    Sets link if their differences from the centre differ in no more than ``allowed`` tokens, a ninth of their sizes' sum, and so have
    at least half of what their differences' sizes exceed that in common. For a set that the centre does not link that is no less
    than its difference without a quarter of its size. A set that the centre links can only meet those that it does not
    link, and then has over 4/9 of its own difference in common. First tokens follow from these bounds, rare ones first.
    """
    rows = answers.select(F.col("a").alias("centre"), F.col("b").alias("key"), F.col("size_b").alias("size"), "linked", "delta").join(centres, ["key", "centre"])
    rows = rows.join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("group", F.coalesce("group", "key"))
    mixed = rows.groupBy("centre").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low <> high").select("centre")
    rows = rows.join(mixed, "centre").withColumn("n", F.size("delta"))
    least = F.when(F.col("linked"), F.floor(F.col("n") * 4 / 9 + 1e-9) + 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("n") - F.col("size") / 4 - 1e-9)))
    rows = rows.select("centre", "key", "group", "size", "n", (F.col("n") - least + 1).alias("first"), F.explode("delta").alias("token"))
    counts = rows.groupBy("centre", "token").agg(F.count(F.lit(1)).alias("count"))
    nth = F.row_number().over(Window.partitionBy("centre", "key").orderBy("count", "token"))
    rows = rows.join(counts.filter("count > 1"), ["centre", "token"], "left").withColumn("count", F.coalesce("count", F.lit(1)))
    # ``left``: the token itself and those behind it. Tokens that only one set has settle no pair.
    rows = rows.withColumn("nth", nth).filter((F.col("nth") <= F.col("first")) & (F.col("count") > 1)).withColumn("left", F.col("n") - F.col("nth") + 1)
    rows = written(rows.select("centre", "token", "key", "group", "size", "n", "left"), "differences")
    a, b = (rows.select("centre", "token", *[F.col(c).alias(f"{c}_{side}") for c in ("key", "group", "size", "n", "left")]) for side in "ab")
    size_a, size_b = F.col("size_a"), F.col("size_b")
    allowed = F.floor((size_a + size_b) / (NUMERATOR + DENOMINATOR) + 1e-9)
    met = a.join(b, ["centre", "token"]).filter(
        (F.col("key_a") < F.col("key_b"))
        & (F.col("group_a") != F.col("group_b"))
        & (DENOMINATOR * F.least(size_a, size_b) >= NUMERATOR * F.greatest(size_a, size_b))
        & (2 * F.least("left_a", "left_b") >= F.col("n_a") + F.col("n_b") - allowed)
    )
    return met.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).distinct()


def _other_pairs(lists: DataFrame, answers: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs that the answers for pivots have not settled: those in one list with different centres, and those with one centre.

    A set meets only the blocks of its list from its own size up to the largest size that its place allows: with ``left``
    tokens to go, sets of more than 9/4 * left - size tokens cannot have enough in common.
    """
    centres = written(_centres(answers), "centres")
    rows = lists.join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("group", F.coalesce("group", "key"))
    rows = rows.join(centres, "key", "left").withColumn("centre", F.coalesce("centre", "key"))
    ends = [f(c).alias(f"{end}_{c}") for c in ("group", "centre") for f, end in ((F.min, "low"), (F.max, "high"))]
    mixed = rows.groupBy("token").agg(*ends).filter("low_group <> high_group AND low_centre <> high_centre").select("token")
    rows = rows.join(mixed, "token").withColumn("left", _left(F.col("size"), F.col("place")))
    size = F.col("size")
    reach = F.least(F.floor(size * DENOMINATOR / NUMERATOR + 1e-9), F.floor(F.col("left") * (NUMERATOR + DENOMINATOR) / NUMERATOR + 1e-9) - size)
    a = rows.filter(reach >= size).select(
        "token", F.col("key").alias("a"), F.col("group").alias("group_a"), F.col("centre").alias("centre_a"), size.alias("size_a"), reach.alias("reach"),
        F.explode(F.sequence(_block(size), _block(reach))).alias("block"),
    )
    b = rows.select("token", F.col("key").alias("b"), F.col("group").alias("group_b"), F.col("centre").alias("centre_b"), size.alias("size_b"), F.col("left").alias("left_b"), _block(size).alias("block"))
    met = a.join(b, ["token", "block"]).filter(
        (F.col("group_a") != F.col("group_b"))
        & (F.col("centre_a") != F.col("centre_b"))
        & ((F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("a") < F.col("b"))))
        & (F.col("size_b") <= F.col("reach"))
        & (F.col("left_b") >= _needed(F.col("size_a"), F.col("size_b")))
    )
    pairs = written(met.select("a", "b", "size_a", "size_b").distinct(), "met")
    # Common first tokens of the pairs met, counted over all lists: a row for each pair, with its two sets' first tokens.
    first = lists.groupBy("key").agg(F.collect_list("token").alias("tokens"))
    common = pairs.join(first.toDF("a", "tokens_a"), "a").join(first.toDF("b", "tokens_b"), "b")
    common = common.withColumn("common", F.size(F.array_intersect("tokens_a", "tokens_b")))
    pairs = common.filter(_enough(F.col("common"), F.col("size_a"), F.col("size_b"))).select("a", "b")
    pairs = pairs.union(_centred_pairs(answers, groups, centres))
    # 1 - similarity is a metric: distances to one pivot that differ by more than the largest one allowed rule a pair out.
    far = answers.select(F.col("a").alias("pivot"), "b", (1 - F.col("similarity")).alias("distance"))
    d_a = far.select("pivot", F.col("b").alias("a"), F.col("distance").alias("distance_a"))
    d_b = far.withColumnRenamed("distance", "distance_b")
    settled = pairs.join(d_a, "a").join(d_b, ["pivot", "b"])
    settled = settled.filter(F.abs(F.col("distance_a") - F.col("distance_b")) > 1 - NUMERATOR / DENOMINATOR + 1e-9)
    known = answers.select("a", "b").union(answers.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.join(settled.select("a", "b").union(known).distinct(), ["a", "b"], "left_anti")


# ---------------------------------------------------------------- verification


def _cells(rows: DataFrame, *columns: str) -> np.ndarray:
    """Presence table of fixed size: a bit for each value that a hash of ``columns`` takes."""
    cell = F.call_function("shiftrightunsigned", F.xxhash64(*columns), F.lit(64 - CELL_BITS))
    words = rows.select(cell.alias("cell")).groupBy(F.expr("cell div 32").alias("word"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, CAST(cell % 32 AS INT))")).alias("bits")).toArrow()
    table = np.zeros((1 << CELL_BITS) // 32, dtype=np.uint32)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return table


def _in_cells(table: np.ndarray, *values: int) -> bool:
    """Whether the table has the bit of ``values``, hashed as ``xxhash64`` does."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=h)
    cell = h >> (64 - CELL_BITS)
    return bool(int(table[cell // 32]) >> (cell % 32) & 1)


def _packed(shingles: np.ndarray) -> bytes:
    """The leading 48 bits of sorted hashes: the first byte of each as a mark behind those of the hashes and values before it, then the
    other five bytes of each."""
    raw = shingles.view(np.uint8).reshape(-1, 8)
    marks = np.zeros(len(raw) + 256, dtype=np.uint8)
    marks[raw[:, 7] + np.arange(len(raw))] = 1
    return struct.pack("<I", len(raw)) + np.packbits(marks).tobytes() + raw[:, 2:7].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    n = struct.unpack_from("<I", raw)[0]
    at = 4 + (n + 256 + 7) // 8
    marks = np.unpackbits(np.frombuffer(raw[4:at], dtype=np.uint8), count=n + 256)
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, :5] = np.frombuffer(raw, dtype=np.uint8, offset=at).reshape(n, 5)
    wide[:, 5] = np.flatnonzero(marks) - np.arange(n)
    return wide.view("<u8").ravel()


def _verified(documents: DataFrame, sets: DataFrame, pairs: DataFrame, deltas: bool = False) -> DataFrame:
    """``pairs`` (a, b) with the fingerprints and the similarity of their sets, and with ``deltas`` the tokens that only one of
    the two has, where they are near.

    Of each set that a pair needs one document is chosen, and presence tables of fixed size keep nearly all other texts
    from being cut and from giving theirs; the join that follows is exact. A set goes once to each first set that it is paired with, where
    the pairs are compared as a stream behind that set; a first set with many partners stands in several places. Tokens are
    sent in 48 bits, of which no two of a pair's are equal by chance but once in a hundred million pairs.
    """
    spark = documents.sparkSession
    pairs = written(pairs, "pairs")
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    chosen = sets.join(keys, "key", "left_semi").groupBy("key", "print").agg(F.coalesce(F.min("doc_id"), F.lit(-1)).alias("doc_id"))
    chosen = written(chosen, "chosen")
    tables = spark.sparkContext.broadcast((_cells(chosen, "doc_id"), _cells(chosen, "key", "doc_id")))

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, wanted = tables.value
        for batch in small_batches(batches):
            out: dict[bytes, tuple[int, bytes]] = {}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                doc = -1 if doc is None else doc
                if _in_cells(asked, doc) and len(shingles := shingle_set(text)):
                    key = short(mark := fingerprint(shingles))
                    if _in_cells(wanted, key, doc):
                        out[mark] = (key, _packed(shingles))
            if out:
                columns = [*zip(*out.values(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(list(out), pa.binary()), pa.array(columns[1], pa.binary())], names=["key", "print", "shingles"]
                )

    given = map_arrow(documents.select("doc_id", "text"), give, "key long, print binary, shingles binary")
    places = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("places"))
    firsts = places.select(F.col("a").alias("key"), F.col("a").alias("at"), F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), F.lit(0).alias("side"))
    others = pairs.join(places, "a").select(
        F.col("b").alias("key"), F.col("a").alias("at"), F.pmod(F.xxhash64("b"), F.col("places")).cast("int").alias("place"), F.lit(1).alias("side")
    )
    sent = given.join(firsts.union(others), "key").select("at", "place", "side", "key", "print", "shingles")
    sent = sent.repartition(partition_count(documents), "at", "place").sortWithinPartitions("at", "place", "side", "print")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first = None, {}
        for batch in small_batches(batches):
            out = []
            for row in batch.to_pylist():
                if (row["at"], row["place"]) != at:
                    at, first = (row["at"], row["place"]), {}
                tokens = _unpacked(row["shingles"])
                if row["side"] == 0:
                    first[row["print"]] = tokens
                    continue
                for mark, other in first.items():
                    n = len(np.intersect1d(other, tokens))
                    together = len(other) + len(tokens) - n
                    delta = np.setxor1d(other, tokens).astype(np.int64) if deltas and n >= CENTRED * together else None
                    out.append((row["at"], row["key"], mark, row["print"], n / together, DENOMINATOR * n >= NUMERATOR * together, len(tokens), delta))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.bool_(), pa.int64(), pa.list_(pa.int64())]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["a", "b", "print_a", "print_b", "similarity", "linked", "size_b", "delta"]
            )

    schema = "a long, b long, print_a binary, print_b binary, similarity double, linked boolean, size_b long, delta array<long>"
    out = map_arrow(sent, compare, schema)
    return written(out.dropDuplicates(["print_a", "print_b"]), "verified")


def mark_groups(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the size of its set and the smallest id its links reach."""
    documents = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    spark = documents.sparkSession
    base = scratch_path(spark, "sets")
    _sets_and_counts(documents, base)
    rows = spark.read.schema("doc_id long, n_shingles long, print binary, key long, slice int, counts binary, kind string").parquet(base)
    sets = rows.filter("kind = 'set'").select("doc_id", "n_shingles", "print", "key")
    levels = rank_levels(_summed_counts(rows.filter("kind = 'count'")))
    lists = written(_lists(_index(documents, levels)), "lists")
    first = _verified(documents, sets, _pivot_pairs(lists), deltas=True)
    near = first.filter("linked")
    groups = components(near.select("a", "b"))
    second = _verified(documents, sets, _other_pairs(lists, first, groups))
    links = near.select("print_a", "print_b").union(second.filter("linked").select("print_a", "print_b"))
    linked = components(links.select(F.col("print_a").alias("a"), F.col("print_b").alias("b")))
    classes = sets.filter(F.col("print").isNotNull()).groupBy("print").agg(F.min("doc_id").alias("least"))
    classes = classes.join(linked.withColumnRenamed("node", "print"), "print", "left").withColumn("group", F.coalesce("group", "print"))
    least = classes.groupBy("group").agg(F.min("least").alias("component"))
    named = written(classes.select("print", "group").join(least, "group").select("print", "component"), "classes")
    out = sets.join(named, "print", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))
