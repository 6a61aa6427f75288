"""Byte-level BPE over a whole corpus: every distinct word is encoded once.

Texts are taken in blocks of bounded size. A block keeps, for each text, the positions of its pre-tokens in the list of
the block's distinct ones, so that positions stay packed and in their place and only distinct words travel: dealt by a hash of the word they meet
in one task, which encodes each of them once, and their ids go back to their blocks and meet the positions. A frequent word costs one entry for each
block and not one for each occurrence. Decoding joins the ids with the table of token bytes.

Blocks are written to the shared folder once, since their numbers must not change when a task is run again.

Defined cases: null text is empty; empty text has no ids; null ids decode to empty bytes, and ids that are no token to nothing; repeated
rows give repeated rows; a text is taken whole, and one that is larger than a block is a block; an empty table gives an empty one;
columns beside the text are kept, the text column is not, and a column called like an added one is replaced.
"""

from __future__ import annotations

import base64
import functools
import heapq
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from threadloom.llm.common import byte_slices, list_array, map_arrow, partition_count
from threadloom.session import scratch_path

# Bytes of text in a block.
BLOCK_BYTES = 16 * 1024**2

# Input bytes for a task that encodes words or puts texts together, and the cells for words that such a task takes: several, so that tasks are even.
TASK_BYTES = 8 * 1024**2
CELLS_PER_TASK = 4

# Ids decoded at a time, or those of one row that has more.
DECODED_IDS = 1 << 18

# Words up to this length are merged by looking at all their pairs, longer ones with a heap.
SHORT_WORD = 48


@functools.lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    """Tokens and their ids, which are also their merge ranks, from a file of base64 tokens."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: of all neighbouring parts the pair of least rank is merged, the leftmost of equal ones, until none is a token."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > SHORT_WORD:
        return _encode_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    near = [ranks.get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while near:
        least = min(near)
        if least == _NONE:
            break
        i = near.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del near[i]
        if i < len(near):
            near[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
        if i:
            near[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
    return [ranks[p] for p in parts]


_NONE = 1 << 62


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As ``encode_word``, in n log n: parts are a linked list, and pairs wait in a heap by rank and place."""
    size = len(word)
    end, before, alive = list(range(1, size + 1)), list(range(-1, size - 1)), [True] * size
    waiting = [(r, i, i + 2) for i in range(size - 1) if (r := ranks.get(word[i : i + 2], -1)) >= 0]
    heapq.heapify(waiting)
    while waiting:
        _, i, stop = heapq.heappop(waiting)
        # A pair is out of date when one of its parts has grown or gone.
        if not alive[i] or end[i] >= size or end[end[i]] != stop:
            continue
        alive[end[i]] = False
        end[i] = stop
        if stop < size:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]], -1)) >= 0:
                heapq.heappush(waiting, (r, i, end[stop]))
        p = before[i]
        if p >= 0 and (r := ranks.get(word[p:stop], -1)) >= 0:
            heapq.heappush(waiting, (r, p, stop))
    return [ranks[word[i : end[i]]] for i in range(size) if alive[i]]


# ---------------------------------------------------------------- blocks

def _pack(positions: np.ndarray, known: int) -> bytes:
    """Positions of a text in its block's list, of which ``known`` entries are older than the text.

    A word met for the first time stands next in the list and is written as 0, any other as its place plus 1; low and high bytes are kept apart.
    """
    highest = np.maximum.accumulate(np.concatenate([[known - 1], positions]))
    marked = np.where(positions > highest[:-1], 0, positions + 1)
    planes = marked.astype("<u4").view(np.uint8).reshape(-1, 4)
    width = next(w for w in (1, 2, 3, 4) if not planes[:, w:].any())
    return struct.pack("<BI", width, known) + zstandard.ZstdCompressor(level=1).compress(planes[:, :width].T.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    width, known = struct.unpack("<BI", packed[:5])
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[5:]), np.uint8).reshape(width, -1)
    wide = np.zeros((planes.shape[1], 4), dtype=np.uint8)
    wide[:, :width] = planes.T
    marked = wide.reshape(-1).view("<u4").astype(np.int64)
    return np.where(marked == 0, known - 1 + np.cumsum(marked == 0), marked - 1)


def _joined(values: list[bytes]) -> tuple[bytes, bytes]:
    """Byte strings one after the other, and their lengths, both compressed."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    return squeeze(b"".join(values)), squeeze(np.array([len(v) for v in values], dtype="<u4").tobytes())


def _parted(data: bytes, lengths: bytes) -> list[bytes]:
    expand = zstandard.ZstdDecompressor().decompress
    data, ends = expand(data), np.cumsum(np.frombuffer(expand(lengths), "<u4")).tolist()
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


CELL = "block bigint, cell int, at binary, data binary, lengths binary"
_CELL_TYPES = [("block", pa.int64()), ("cell", pa.int32()), ("at", pa.binary()), ("data", pa.binary()), ("lengths", pa.binary())]


def _cells(block: int, number: dict[str, int], cells: int) -> list[tuple]:
    """The block's words dealt into cells by a hash of the word, each with the words' places in the block's list."""
    found = defaultdict(list)
    for word, at in number.items():
        raw = word.encode()
        found[zlib.crc32(raw) % cells].append((raw, at))
    out = []
    for cell, words in sorted(found.items()):
        words.sort()
        out.append((block, cell, np.array([at for _, at in words], dtype="<u4").tobytes(), *_joined([w for w, _ in words])))
    return out


def encode_texts(
    df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", block_bytes: int | None = None
) -> DataFrame:
    """``df`` with the token ids (array of int) of each whole text in place of the text.

    ``path`` is a file of ranked tokens, ``pattern`` what words are cut by. The blocks are written to the shared folder as a table bucketed
    by block, so that the positions are not shuffled: only the words go out by their hash and the ids come back by their block.
    """
    spark = df.sparkSession
    kept = [f for f in df.schema.fields if f.name not in (text, ids)]
    # Numbered names cannot clash with those of the block.
    names = [f"c{i}" for i in range(len(kept))]
    columns = "".join(f", {n} {f.dataType.simpleString()}" for n, f in zip(names, kept, strict=True))
    schema = f"kind int, {CELL}, packed binary{columns}"
    tasks, most = partition_count(df, TASK_BYTES), block_bytes or BLOCK_BYTES
    cells = CELLS_PER_TASK * tasks

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, block = regex.compile(pattern).findall, TaskContext.get().partitionId() << 32
        for batch in byte_slices(batches, "text", most):
            number: dict[str, int] = defaultdict(count().__next__)
            packed = []
            for value in batch.column("text").to_pylist():
                found, known = find(value) if value else [], len(number)
                packed.append(_pack(np.fromiter(map(number.__getitem__, found), np.int64, len(found)), known))
            size, others = batch.num_rows, [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(size, np.int32)), pa.array(np.full(size, block)), *[pa.nulls(size, t) for _, t in _CELL_TYPES[1:]], pa.array(packed, pa.binary()), *others],
                names=["kind", *[n for n, _ in _CELL_TYPES], "packed", *names],
            )
            rows = _cells(block, number, cells)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(len(rows), np.int32)), *[pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True) if rows else [[]] * 5, _CELL_TYPES, strict=True)],
                 pa.nulls(len(rows), pa.binary()), *[pa.nulls(len(rows), o.type) for o in others]],
                names=["kind", *[n for n, _ in _CELL_TYPES], "packed", *names],
            )
            block += 1

    rows = df.select(*[F.col(f"`{f.name}`").alias(n) for n, f in zip(names, kept, strict=True)], F.col(f"`{text}`").alias("text"))
    folder = scratch_path(spark, "word-blocks")
    table = "word_blocks_" + folder[-32:]
    writer = map_arrow(rows, pack, schema).write.partitionBy("kind").bucketBy(tasks, "block")
    writer.format("parquet").option("path", folder).option("compression", "zstd").saveAsTable(table)
    stored = spark.table(table)
    texts = stored.filter("kind = 0").select("block", "packed", *names)
    words = stored.filter("kind = 1").select(*[n for n, _ in _CELL_TYPES])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All blocks' rows of a word are in one task, which encodes it the first time it comes."""
        ranks, done = ranks_of(path), {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                found = []
                for word in _parted(row["data"], row["lengths"]):
                    known = done.get(word)
                    if known is None:
                        known = done[word] = np.array(encode_word(word, ranks), dtype="<u4").tobytes()
                    found.append(known)
                out.append((row["block"], row["cell"], row["at"], *_joined(found)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True) if out else [[]] * 5, _CELL_TYPES, strict=True)], names=[n for n, _ in _CELL_TYPES])

    encoded = map_arrow(words.repartition(tasks, "cell"), encode, CELL)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        """Put the block's words into the order of its list, and gather their ids by the positions of each text."""
        at, found = [np.zeros(0, "<u4")], []
        for row in right.to_pylist():
            at.append(np.frombuffer(row["at"], "<u4"))
            found += _parted(row["data"], row["lengths"])
        order = np.argsort(np.concatenate(at))
        found = [found[i] for i in order]
        sizes = np.array([len(f) // 4 for f in found], dtype=np.int64)
        flat, starts = np.frombuffer(b"".join(found), "<u4").astype(np.int32), np.cumsum(sizes) - sizes
        del order
        lists, lengths = [np.zeros(0, np.int32)], []
        for packed in left.column("packed").to_pylist():
            positions = _unpack(packed)
            number = sizes[positions]
            places = np.arange(number.sum()) + np.repeat(starts[positions] - (np.cumsum(number) - number), number)
            lists.append(flat[places])
            lengths.append(len(places))
        new = list_array(np.concatenate(lists), lengths)
        return pa.table([*[left.column(n) for n in names], new], names=[*names, "ids"])

    met = texts.groupBy("block").cogroup(encoded.repartition(tasks, "block").groupBy("block")).applyInArrow(meet, f"{columns[2:]}{', ' if columns else ''}ids array<int>")
    return met.select(*[F.col(n).alias(f.name) for n, f in zip(names, kept, strict=True)], F.col("ids").alias(ids))


# ---------------------------------------------------------------- ids to bytes

class TokenBytes:
    """The token-byte table: bytes of all tokens one after the other, with the place and length of each by id."""

    def __init__(self, path: str):
        ranks = ranks_of(path)
        self.sizes = np.zeros(max(ranks.values()) + 2, dtype=np.int64)
        ordered = sorted(ranks.items(), key=lambda item: item[1])
        self.sizes[[i for _, i in ordered]] = [len(token) for token, _ in ordered]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.joined = np.frombuffer(b"".join(token for token, _ in ordered), np.uint8)

    def join(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, one after the other, and how many each has: none for an id that is no token (the last entry stands for these)."""
        ids = np.where((ids >= 0) & (ids < len(self.sizes)), ids, len(self.sizes) - 1)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.joined[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - sizes), sizes)], sizes


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> TokenBytes:
    return TokenBytes(path)


def decoded_batches(batches: Iterator[pa.RecordBatch], path: str, ids: str = "ids", decoded: str = "decoded") -> Iterator[pa.RecordBatch]:
    """The batches with the bytes of each row's ids in place of the ids, some rows at a time."""
    table = token_bytes(path)
    for whole in batches:
        lengths = pc.fill_null(pc.list_value_length(whole.column(ids)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(lengths), 0
        while start < whole.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] - lengths[start] + DECODED_IDS, "right")))
            batch = whole.slice(start, stop - start)
            flat = pc.fill_null(batch.column(ids).flatten(), -1).to_numpy(zero_copy_only=False)
            data, sizes = table.join(flat)
            total = np.concatenate([[0], np.cumsum(sizes)])
            cuts = total[np.concatenate([[0], np.cumsum(lengths[start:stop])])].astype(np.int32)
            new = pa.BinaryArray.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
            kept = [n for n in batch.schema.names if n not in (ids, decoded)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], new], names=[*kept, decoded])
            start = stop


def decode_ids(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the bytes of each row's token ids in place of the ids.

    All ids of a batch are joined with the token-byte table at once. The table is as small as vocabularies are, so every worker holds it and
    the join is made where the rows are, without a shuffle, as a broadcast join would be.
    """
    columns = [f for f in df.schema.fields if f.name not in (ids, decoded)]
    return map_arrow(df, lambda batches: decoded_batches(batches, path, ids, decoded), StructType([*columns, StructField(decoded, BinaryType())]))
