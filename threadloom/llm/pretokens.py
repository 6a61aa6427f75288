"""Cutting text into the pieces a byte-level BPE encodes on their own, with what they encode to remembered.

The pre-tokenizer puts a boundary before every blank that another character than white space follows, so text can
be cut there first, with the fast ``str.split``, and the exact pattern is only run on chunks not seen before.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Callable

import numpy as np
import regex

# Unicode white space, and the pattern that the byte-level pre-tokenizer splits by.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

CUT = re.compile(f" (?=[^{SPACE}])")
NO_CUT = re.compile(f" (?:[{SPACE}]|\\Z)")

# Entries that a worker keeps for good, which the frequent ones soon are, and those that make room for newer ones.
KEPT = 300_000
KEPT_FOR_A_WHILE = 150_000
# Marks the chunk at the beginning of a text. No other chunk holds it: text is cut at a blank before such a character.
FIRST = "\x00 \x00"


class _Memory(dict):
    """Ids by text: what comes first stays, later entries make room for newer ones."""

    def __init__(self, kept: int, kept_for_a_while: int):
        self.kept, self.kept_for_a_while = kept, kept_for_a_while
        self.recent: list[str] = []

    def put(self, values: dict[str, bytes]) -> None:
        room = self.kept - (len(self) - len(self.recent))
        self.recent += itertools.islice(values, max(0, room), None)
        self.update(values)

    def make_room(self) -> None:
        if len(self.recent) > self.kept_for_a_while:
            for text in self.recent:
                del self[text]
            self.recent = []


class PieceEncoder:
    """Ids of whole texts, as little-endian uint32, from ``encode_pieces``, which encodes a sorted list of pre-tokens.

    Texts come in batches. What a batch has that is not remembered is encoded first, in one call.
    """

    def __init__(
        self, encode_pieces: Callable[[list[str]], list[bytes]], added: dict[str, int], kept: int | None = None, kept_for_a_while: int | None = None
    ):
        self.encode_pieces, self.split = encode_pieces, regex.compile(PATTERN).findall
        bounds = KEPT if kept is None else kept, KEPT_FOR_A_WHILE if kept_for_a_while is None else kept_for_a_while
        self.pieces, self.chunks = _Memory(*bounds), _Memory(*bounds)
        self.added = {text: np.array([i], dtype="<u4").tobytes() for text, i in added.items()}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def _cut(self, text: str) -> list[str]:
        """Chunks, the blank before each but the first left out and the first one marked."""
        chunks = CUT.split(text) if NO_CUT.search(text) else text.split(" ")
        chunks[0] += FIRST
        return chunks

    def _learn(self, chunks: set[str]) -> None:
        self.chunks.make_room()
        self.pieces.make_room()
        new = chunks - self.chunks.keys()
        split = {c: self.split(c[: -len(FIRST)] if c.endswith(FIRST) else " " + c) for c in new}
        pieces = sorted(set().union(*split.values()) - self.pieces.keys())
        self.pieces.put(dict(zip(pieces, self.encode_pieces(pieces), strict=True)))
        get = self.pieces.__getitem__
        self.chunks.put({c: b"".join(map(get, found)) for c, found in split.items()})

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (null counts as empty); the text of an added token gives that token, as in the library."""
        parts = []
        for text in texts:
            if text and self.at_added is not None and any(a in text for a in self.added):
                parts.append(self.at_added.split(text))
            else:
                parts.append([text or ""])
        cut = [[self._cut(p) if p and not i % 2 else [] for i, p in enumerate(found)] for found in parts]
        self._learn(set().union(*(chunks for found in cut for chunks in found)))
        get = self.chunks.__getitem__
        return [
            b"".join(self.added[p] if i % 2 else b"".join(map(get, chunks)) for i, (p, chunks) in enumerate(zip(*both, strict=True)))
            for both in zip(parts, cut, strict=True)
        ]


def added_tokens(path: str) -> dict[str, int]:
    """Tokens beside the vocabulary, of the tokenizer file at ``path``."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
