"""Search for licence notices, whole phrases and notices with a bounded number of edits.

Text is read as words, lower-cased in A-Z and joined by single blanks. Base phrases are found word for word. A notice
that may differ in ``k`` characters is cut into ``k + 1`` pieces: whatever the edits are, one piece is left unharmed, so
exact hits of the pieces, found for all notices in one pass of an automaton, name every place where the notice can
stand. The bounded-error matching of the regex library then verifies the place and counts the edits.

Defined cases: null and empty text, and text without words, have no words, no labels and score 0; places may overlap
and all count; repeated rows give repeated rows; columns beside the text are kept, those named like an added one are
replaced. A document is one row of one task; its windows are as long as a notice, however long the text is.
"""

from __future__ import annotations

import bisect
import functools

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from threadloom.llm.common import map_batches, schema_with, with_columns

# Base phrases with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Short notices and the label of each, in words as they are compared.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "apache license version 2 0 january 2004": "apache-2.0",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu general public license version 2": "gpl-2.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "this program is free software you can redistribute it and or modify it": "gnu",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "released under the mit license": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "subject to the terms of the mozilla public license": "mpl",
    "eclipse public license": "epl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "creative commons attribution": "cc",
    "released into the public domain": "public-domain",
}

# One edit is allowed for each so many characters of a notice.
CHARS_PER_EDIT = 12

WORD_BYTES = bytes(b for b in range(256) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
AS_WORDS = bytes((b + 32 if 65 <= b <= 90 else b) if b in WORD_BYTES else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 text: runs of digits, letters and all characters beyond ASCII, with A-Z lower-cased."""
    return text.translate(AS_WORDS).split() if text else []


class NoticeSearch:
    """Automaton of the pieces and the patterns that verify."""

    def __init__(self, notices: dict[str, str], chars_per_edit: int = CHARS_PER_EDIT):
        self.rules = []
        self.pieces = ahocorasick.Automaton()
        for number, (notice, label) in enumerate(notices.items()):
            edits = len(notice) // chars_per_edit
            self.rules.append((notice, label, edits, regex.compile(f"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}")))
            cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                piece = notice[start:stop]
                at = self.pieces.get(piece, None)
                if at is None:
                    self.pieces.add_word(piece, at := [])
                at.append((number, start, len(piece)))
        self.pieces.make_automaton()

    def find(self, text: str) -> list[tuple[str, int, int, int]]:
        """(label, start, end, edits) of each notice found; of overlapping finds the closest is reported."""
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, hits in self.pieces.iter(text):
            for number, offset, size in hits:
                notice, _, edits, _ = self.rules[number]
                start = end + 1 - size - offset
                windows.setdefault(number, []).append((max(0, start - edits), min(len(text), start + len(notice) + edits)))
        found = []
        for number, places in windows.items():
            _, label, edits, pattern = self.rules[number]
            done = -1
            for start, stop in sorted(set(places)):
                if start < done:
                    start = done
                match = pattern.search(text, start, stop) if stop > start else None
                if match:
                    found.append((label, match.start(), match.end(), sum(match.fuzzy_counts)))
                    done = match.end()
        # Of notices found in the same words, such as two versions of a licence, the closest stays.
        kept: list[tuple[str, int, int, int]] = []
        for f in sorted(found, key=lambda f: (f[3] / (f[2] - f[1] + 1), f[1] - f[2], f[0], f[1])):
            at = bisect.bisect(kept, f[1], key=lambda k: k[1])
            if (at == 0 or kept[at - 1][2] <= f[1]) and (at == len(kept) or f[2] <= kept[at][1]):
                kept.insert(at, f)
        return kept


@functools.lru_cache(maxsize=4)
def search(notices: tuple[tuple[str, str], ...], chars_per_edit: int) -> NoticeSearch:
    return NoticeSearch(dict(notices), chars_per_edit)


def base_places(joined: bytes, phrase: str) -> list[int]:
    """Word numbers where ``phrase`` begins in words joined by blanks."""
    padded, wanted = b" " + joined + b" ", b" " + phrase.encode() + b" "
    places, at, word, counted = [], padded.find(wanted), 0, 0
    while at >= 0:
        word += padded.count(b" ", counted, at)
        counted = at
        places.append(word)
        at = padded.find(wanted, at + 1)
    return places


SPAN = "array<struct<label: string, first_word: long, last_word: long, edits: int>>"
ADDED = {
    "n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long",
    "base_labels": "string", "labels": "string", "score": "double", "spans": SPAN,
}


def scan_row(text: bytes | None, finder: NoticeSearch, base: dict[str, str]) -> tuple:
    words = words_of(text)
    joined = b" ".join(words)
    places, base_labels = [], set()
    for phrase, label in base.items():
        if here := base_places(joined, phrase):
            places += here
            base_labels.add(label)
    spans, closeness = [], 1.0 if places else 0.0
    plain = joined.decode("latin-1")
    for label, start, end, edits in finder.find(plain):
        first = plain.count(" ", 0, start)
        spans.append({"label": label, "first_word": first, "last_word": first + plain.count(" ", start, end), "edits": edits})
        closeness = max(closeness, 1.0 - edits / (end - start + 1))
    labels = base_labels | {s["label"] for s in spans}
    return (
        len(words), len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted(base_labels)), ",".join(sorted(labels)), closeness, spans,
    )


def scan(
    df: DataFrame,
    text: str = "text",
    base: dict[str, str] | None = None,
    notices: dict[str, str] | None = None,
    chars_per_edit: int = CHARS_PER_EDIT,
) -> DataFrame:
    """``df`` with the word count, base places, labels, score and ``spans`` of each whole text. No shuffle."""
    base = BASE if base is None else base
    rules = tuple((NOTICES if notices is None else notices).items())
    out = schema_with(df, **ADDED)
    types = {f.name: f.dataType for f in out.fields}
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = {name: to_arrow_type(types[name]) for name in ADDED}

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        finder = search(rules, chars_per_edit)
        raw = batch.column(text).cast(pa.large_binary())
        scanned = [scan_row(t.as_py(), finder, base) for t in raw]
        columns = zip(*scanned, strict=True)
        return with_columns(batch, **{n: pa.array(list(c), arrow[n]) for n, c in zip(ADDED, columns, strict=True)})

    return map_batches(df, out, rows)
