"""Exact byte-level BPE by dynamic programming over prefixes.

For every prefix of a pre-token exactly one token can stand last in its BPE encoding. It is the one among the tokens
that end there (found by an Aho-Corasick automaton of the vocabulary, in place of a suffix automaton) whose predecessor, the last token of the prefix
before it, may stand beside it: no merge across their border would have come before the merges inside them. Storing
the last token of each prefix gives the ids by following the pointers back; no merge loop runs over the text.

Defined cases: null text is empty; empty text has no ids and decodes to empty text; repeated rows give repeated rows;
columns beside the text are kept, one that is called like an added column is replaced. Ids that are no token decode
to nothing; bytes that are no UTF-8 decode to the replacement character.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from threadloom.llm.common import SLICE_BYTES, byte_slices, give_back, held, list_array, map_arrow, map_batches, schema_with, with_columns
from threadloom.llm.pretokens import PieceEncoder, added_tokens


# What a worker keeps: results of pair tests, and ids of pieces and of chunks, for good and for a while. An executor holds that once for
# each of its cores, beside a heap that earlier stages of the pipeline have grown.
PAIRS_KEPT = 200_000
KEPT, KEPT_FOR_A_WHILE = 200_000, 50_000


def printable_bytes() -> dict[str, int]:
    """The characters that tokenizer files write for bytes: printable ones stand for themselves, the others follow 255."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    other = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(other)}}


class PrefixBpe:
    """Vocabulary, automaton and merge trees of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        to_byte, vocab = printable_bytes(), model["vocab"]
        self.bytes_of: dict[int, bytes] = {}
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for token, i in vocab.items():
            if all(c in to_byte for c in token):
                self.bytes_of[i] = bytes(to_byte[c] for c in token)
                if len(token) == 1:
                    self.rank[i] = -1
        for rank, (left, right) in enumerate(model["merges"]):
            made, pair = vocab[left + right], (vocab[left], vocab[right])
            self.merged[pair] = rank
            if made not in self.halves and made not in self.rank:
                self.halves[made], self.rank[made] = pair, rank
        self.automaton = ahocorasick.Automaton()
        for i, raw in self.bytes_of.items():
            if i in self.rank:
                self.automaton.add_word(raw.decode("latin-1"), (len(raw), i))
        self.automaton.make_automaton()
        self.beside: dict[int, bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` and ``right`` side by side: take their merges back, latest first, and see at each
        moment whether the two tokens at the border would have merged before the next of those merges."""
        rank, bound = self.rank, 1 << 60
        while True:
            if self.merged.get((left, right), bound) < bound:
                return False
            if rank[left] > rank[right]:
                bound = rank[left]
                left = self.halves[left][1]
            elif rank[right] >= 0:
                bound = rank[right] + 1  # of equal merges the one further left comes first
                right = self.halves[right][0]
            else:
                return True

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each pre-token. In sorted order neighbours begin alike, and what is stored of their common prefixes stays."""
        out, before_text = [], ""
        # Of each prefix, by its last place: its last token and where that begins, -1 while unknown.
        last: list[int] = []
        begins: list[int] = []
        beside, fits = self.beside, self.compatible
        for piece in pieces:
            text = piece.encode().decode("latin-1")
            done = len(os.path.commonprefix((before_text, text))) - 1
            before_text = text
            last[done + 1 :] = [-1] * (len(text) - done - 1)
            begins[done + 1 :] = last[done + 1 :]
            for end, (size, token) in self.automaton.iter(text):  # of the tokens with one end, the longest comes first
                if end <= done:
                    continue
                start = end - size
                if start >= 0:
                    before = last[start]
                    pair = before << 20 | token
                    if pair not in beside:
                        if len(beside) >= PAIRS_KEPT:
                            beside.clear()
                        beside[pair] = before >= 0 and fits(before, token)
                    if not beside[pair]:
                        continue
                last[end], begins[end], done = token, start, end
            ids, at = [], len(text) - 1
            while at >= 0:
                ids.append(last[at])
                at = begins[at]
            ids.reverse()
            out.append(ids)
        return out


def encoder(path: str) -> PieceEncoder:
    def build() -> PieceEncoder:
        bpe = PrefixBpe(path)
        ids_of = lambda pieces: [np.array(ids, dtype="<u4").tobytes() for ids in bpe.encode(pieces)]
        return PieceEncoder(ids_of, added_tokens(path), KEPT, KEPT_FOR_A_WHILE)

    return held("bpe", ("encoder", path), build)


class TokenBytes:
    """Bytes of all tokens one after the other, with the place and length of each; added tokens included."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        to_byte, added = printable_bytes(), added_tokens(path)
        known = {i: bytes(to_byte[c] for c in token) for token, i in vocab.items() if all(c in to_byte for c in token)}
        known |= {i: text.encode() for text, i in added.items()}
        pieces = [known.get(i, b"") for i in range(max(known) + 1)]
        self.sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.joined = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        ids = ids[(ids >= 0) & (ids < len(self.sizes))]
        if not len(ids):
            return ""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.joined[places].tobytes().decode("utf-8", "replace")


def decoder(path: str, operator: str = "bpe") -> TokenBytes:
    return held(operator, ("decoder", path), lambda: TokenBytes(path))


def decode(ids: Iterable[int], path: str) -> str:
    return decoder(path).decode(np.array(list(ids), dtype=np.int64))


def encode_texts(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the token ids of each whole text as ``ids`` (array of int). No shuffle; a task holds one batch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, text, SLICE_BYTES):
            raw = encoder(path).encode(batch.column(text).to_pylist())
            flat = np.frombuffer(b"".join(raw), dtype="<u4").astype(np.int32)
            yield with_columns(batch, **{ids: list_array(flat, [len(r) // 4 for r in raw])})
        give_back()

    return map_arrow(df, rows, schema_with(df, **{ids: "array<int>"}))


def decode_ids(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded", after_encoding: bool = False) -> DataFrame:
    """``df`` with the text of each row's token ids as ``text``; null ids give empty text. ``after_encoding``: no task encodes any
    more, so workers drop what encoding has left in them."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists, known = batch.column(ids), decoder(path, "bpe_decoding" if after_encoding else "bpe")
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
        texts = [known.decode(flat[start:end]) for start, end in zip([0, *ends[:-1]], ends, strict=True)]
        return with_columns(batch, **{text: pa.array(texts, pa.string())})

    return map_batches(df, schema_with(df, **{text: "string"}), rows)
