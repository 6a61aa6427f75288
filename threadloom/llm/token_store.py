"""Token ids in blocks with Elias-Fano encoded document boundaries.

A store is a table of blocks. A block holds the ids of a run of documents one after the other, as 16-bit numbers where
the vocabulary allows it, and the ends of the documents as an Elias-Fano sequence: the low bits of each end packed,
the high parts in unary, with the place of every 64th end sampled so that the end of document ``i`` is found without
reading the ends before it. That is about two bits plus log2(ids / documents) for each document. Blocks are
numbered by part and place, and a document's offset in the whole store is its offset in the block plus the ids
of the blocks before, which needs one number for each part.

The blocks go through Spark's own writer, so they can lie in any store Spark writes to and a lost task is just repeated.

Defined cases: null text is empty; every document has its end id, so an empty one has one id; null doc_id comes first;
rows that repeat a doc_id are kept, in the order of their text's hash; other columns are not stored. An empty table
gives an empty store.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.bpe import printable_bytes
from threadloom.llm.common import SLICE_BYTES, byte_slices, held, map_arrow, partition_count
from threadloom.llm.pretokens import FIRST, PieceEncoder, added_tokens

SAMPLED = 64
BLOCK_IDS = 1 << 20
# Chunks that the library gets as one text.
RUN = 500


class EliasFano:
    """A sorted sequence of numbers in close to the least space, with a select structure."""

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.count, self.low_bits, self.low, self.high, self.samples = count, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        count, most = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (max(1, most) // max(1, count)).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(count)
        bits = np.zeros((int(places[-1]) + 1 if count else 0), dtype=np.uint8)
        bits[places] = 1
        return cls(count, low_bits, low, np.packbits(bits, bitorder="little"), places[::SAMPLED].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = np.array([self.count, self.low_bits, len(self.low), len(self.high)], dtype="<u4")
        return head.tobytes() + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        count, low_bits, n_low, n_high = (int(x) for x in np.frombuffer(raw, dtype="<u4", count=4))
        low = np.frombuffer(raw, np.uint8, n_low, 16)
        high = np.frombuffer(raw, np.uint8, n_high, 16 + n_low)
        return cls(count, low_bits, low, high, np.frombuffer(raw, "<u4", offset=16 + n_low + n_high))

    def _low(self, first: int, count: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(count, dtype=np.uint64)
        at = first * self.low_bits
        byte = at // 8
        bits = np.unpackbits(self.low[byte : (at + count * self.low_bits + 7) // 8], bitorder="little")
        bits = bits[at - byte * 8 :][: count * self.low_bits].reshape(count, self.low_bits).astype(np.uint64)
        return bits @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))

    def select(self, i: int) -> int:
        """The ``i``-th number: from the sampled place before it, on to its bit in the high part."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLED]), i % SAMPLED
        byte, start = place // 8, place
        while left:
            width = 64
            bits = np.unpackbits(self.high[byte : byte + width], bitorder="little")
            ones = np.flatnonzero(bits) + byte * 8
            ones = ones[ones > start]
            if len(ones) >= left:
                place = int(ones[left - 1])
                break
            left -= len(ones)
            byte += width
            start = byte * 8 - 1
        return ((place - i) << self.low_bits) | int(self._low(i, 1)[0])

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        high = (places - np.arange(self.count)).astype(np.uint64) << np.uint64(self.low_bits)
        return (high | self._low(0, self.count)).astype(np.int64)


class LibraryEncoder(PieceEncoder):
    """Ids from the tokenizers library, asked once for each chunk of text.

    New chunks are joined again, so that the library cuts and encodes many at a time: it, too, puts a boundary before each blank that
    another character than white space follows. As all bytes are tokens, the bytes of the ids tell where a chunk ends. The first chunk of
    a text has no such blank and goes alone, as all do where an added token holds a blank or a byte is no token.
    """

    def __init__(self, path: str):
        import tokenizers

        super().__init__(self._encode_all, added_tokens(path))
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary, plain = self.library.get_vocab(with_added_tokens=False), printable_bytes()
        self.sizes = np.zeros(max(vocabulary.values(), default=-1) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)  # a character for each byte
        self.joined = all(c in vocabulary for c in plain) and not any(" " in a for a in self.added)

    def _encode_all(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_joined(self, chunks: list[str]) -> Iterator[bytes]:
        runs = [" " + " ".join(chunks[i : i + RUN]) for i in range(0, len(chunks), RUN)]
        raw = b"".join(self._encode_all(runs))
        ends = np.cumsum(pc.binary_length(pa.array(chunks, pa.string())).to_numpy().astype(np.int64) + 1)
        at = np.cumsum(self.sizes[np.frombuffer(raw, dtype="<u4")])
        stops = np.searchsorted(at, ends)
        if not np.array_equal(at[stops], ends):
            raise RuntimeError("the library's tokens do not end where the chunks do")
        start = 0
        for stop in (4 * (stops + 1)).tolist():
            yield raw[start:stop]
            start = stop

    def _learn(self, chunks: set[str]) -> None:
        self.chunks.make_room()
        new = chunks - self.chunks.keys()
        joined = [c for c in new if not c.endswith(FIRST)] if self.joined else []
        alone = list(new.difference(joined))
        if joined:
            self.chunks.put(dict(zip(joined, self._encode_joined(joined), strict=True)))
        texts = [c.removesuffix(FIRST) if c.endswith(FIRST) else " " + c for c in alone]
        self.chunks.put(dict(zip(alone, self._encode_all(texts), strict=True)))


def library_encoder(path: str) -> LibraryEncoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks of an executor run side by side already
    return held("token_store", path, lambda: LibraryEncoder(path))


BLOCKS = "part int, block int, before long, n_docs int, n_ids long, width int, doc_ids array<long>, ends binary, ids binary"


def write_store(
    df: DataFrame, target: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS
) -> None:
    """Write the ids of ``df``'s texts to ``target`` in ascending ``doc_id`` order.

    The texts are range-partitioned once; a task holds one block of ids, closed at ``block_ids`` or, if larger, after
    the document that fills it.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = (
        rows.repartitionByRange(partition_count(rows), "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = library_encoder(tokenizer).encode, np.array([end_id], dtype="<u4").tobytes()
        part, number, before, names, raw, held = 0, 0, 0, [], [], 0

        def closed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(raw), dtype="<u4")
            width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
            ends = EliasFano.of(np.cumsum([len(r) // 4 for r in raw]))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([len(names)], pa.int32()),
                    pa.array([len(ids)], pa.int64()), pa.array([width], pa.int32()), pa.array([names], pa.list_(pa.int64())),
                    pa.array([ends.to_bytes()], pa.binary()), pa.array([ids.astype(f"<u{width}").tobytes()], pa.binary()),
                ],
                names=["part", "block", "before", "n_docs", "n_ids", "width", "doc_ids", "ends", "ids"],
            )

        for batch in byte_slices(batches, "text", SLICE_BYTES):
            part = batch.column(2)[0].as_py()
            for name, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                names.append(name)
                raw.append(ids + end)
                held += len(raw[-1]) // 4
                if held >= block_ids:
                    yield closed()
                    number, before, names, raw, held = number + 1, before + held, [], [], 0
        if names:
            yield closed()

    map_arrow(ordered, blocks, BLOCKS).write.option("compression", "zstd").parquet(target)


def read_store(spark: SparkSession, target: str) -> DataFrame:
    """Blocks of a store with ``base``, the ids of all blocks before. One number for each part is broadcast; parts are
    the write's tasks, of which there are ``MAX_PARTITIONS`` or the session's shuffle partitions at most."""
    blocks = spark.read.schema(BLOCKS).parquet(target)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("total"))
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_base"))
    return blocks.join(F.broadcast(bases), "part").withColumn("base", F.col("part_base") + F.col("before"))


DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def documents_of(blocks: DataFrame, with_ids: bool = False) -> DataFrame:
    """Each document of ``read_store``'s blocks with its place, checksum and, if asked for, its ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                names, raw_ends, raw_ids, width, base = (batch.column(c)[b].as_py() for c in ("doc_ids", "ends", "ids", "width", "base"))
                ids = np.frombuffer(raw_ids, dtype=f"<u{width}").astype("<u4")
                ends = EliasFano.from_bytes(raw_ends).all()
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(names, pa.int64()), pa.array(starts + base), pa.array(ends - starts), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]).astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return map_arrow(blocks, rows, DOCUMENTS + (", ids array<long>" if with_ids else ""))
