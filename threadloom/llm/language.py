"""Language of text by unigram pieces, summed over all segmentations.

For each language every piece of a fixed public vocabulary has a probability. A word's probability is the sum over all
ways to cut it into pieces, which the forward algorithm gives in one pass over its characters; a text's is the product
over its words. The piece probabilities are fitted by expectation-maximisation: forward and backward sums give
each piece's expected count in the words of a language.

Words are cut at ASCII characters that are no letters. A run of more than ``LONG_WORD`` characters, as in scripts without
blanks, is cut at Unicode punctuation and then after every ``LONG_WORD`` characters, for learning and prediction alike.

Fitting uses at most ``sample`` labelled documents for each language, those of smallest hashed id, and of their
words the ``MODEL_WORDS`` most frequent for each language (equally frequent ones by hash); all languages are learned.

Defined cases: null text, and text without a letter, is ``und`` with score 0; null labels and null ids are not learned
from; with nothing to learn from every text is ``und``; equal scores go to the first language in alphabetical order.
Repeated rows give repeated rows; other columns are kept, those named like an added one are replaced.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import SLICE_BYTES, byte_slices, drop_held, give_back, map_arrow, schema_with, with_columns

SAMPLE = 4_000
MODEL_WORDS = 6_000
ROUNDS = 3
SMOOTHING = 0.1
UNKNOWN = "und"
REMEMBERED = 400_000
CELLS_REMEMBERED = 64 * REMEMBERED  # numbers of remembered words, one for each language
LONG_WORD = 48
START = "▁"

AS_LETTERS = bytes((b + 32 if 65 <= b <= 90 else b) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters and other characters beyond ASCII, lower-cased, of at most ``LONG_WORD`` characters."""
    words = text.lower().encode().translate(AS_LETTERS).split() if text else []
    if max(map(len, words), default=0) <= LONG_WORD:
        return words
    return [part for w in words for part in (parts_of(w) if len(w) > LONG_WORD else [w])]


def parts_of(run: bytes) -> list[bytes]:
    """A run of many characters in pieces; one of few characters whole."""
    text = run.decode()
    if len(text) <= LONG_WORD:
        return [run]
    parts = "".join(" " if unicodedata.category(c)[0] in "PZ" else c for c in text).split()
    return [part[i : i + LONG_WORD].encode() for part in parts for i in range(0, len(part), LONG_WORD)]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def vocabulary(path: str) -> list[str]:
    """Pieces of a sentencepiece file that stand for text."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    return [pieces.id_to_piece(i) for i in range(pieces.get_piece_size()) if not (pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_byte(i))]


def matcher(pieces: list[str]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for p in pieces:
        automaton.add_word(p, (len(p), p))
    if pieces:
        automaton.make_automaton()
    return automaton


def cuts_of(word: str, automaton: ahocorasick.Automaton, known: set[str] | dict) -> list[tuple[int, int, str]]:
    """(start, end, piece) of all pieces in ``word``, by end; a character without a piece of its own is one."""
    marked, found, single = START + word, [], set()
    if len(automaton):
        for end, (size, piece) in automaton.iter(marked):
            if piece in known:
                found.append((end + 1 - size, end + 1, piece))
                if size == 1:
                    single.add(end)
    found += [(i, i + 1, "") for i in range(len(marked)) if i not in single]
    return sorted(found, key=lambda c: (c[1], c[0]))


def fit_pieces(words: list[tuple[str, int]], automaton: ahocorasick.Automaton, known: set[str], rounds: int = ROUNDS) -> dict[str, float]:
    """Piece probabilities of one language by expectation-maximisation over its words and their counts.

    The empty piece stands for a character that no piece covers.
    """
    cuts = [(len(w) + 1, cuts_of(w, automaton, known), n) for w, n in words]
    seen = {p for _, c, _ in cuts for _, _, p in c}
    probability = dict.fromkeys(seen, 1.0 / max(1, len(seen)))
    for _ in range(rounds):
        expected: dict[str, float] = defaultdict(float)
        for size, found, n in cuts:
            forward, backward = [1.0] + [0.0] * size, [0.0] * size + [1.0]
            for start, end, piece in found:
                forward[end] += forward[start] * probability[piece]
            for start, end, piece in reversed(found):
                backward[start] += backward[end] * probability[piece]
            if forward[size] > 0:
                for start, end, piece in found:
                    expected[piece] += n * forward[start] * probability[piece] * backward[end] / forward[size]
        total = sum(expected.values()) or 1.0
        probability = {p: expected[p] / total for p in seen}
    return probability


@dataclass
class Model:
    languages: list[str]
    pieces: dict[str, tuple[float, ...]]  # probability in each language
    rest: tuple[float, ...]  # of a piece that a language was not seen with
    automaton: object = field(default=None, repr=False, compare=False)

    def ready(self) -> Model:
        if self.automaton is None:
            self.automaton = matcher([p for p in self.pieces if p])
        return self

    def word(self, word: str) -> tuple[float, ...]:
        """Log probability in each language, summed over the segmentations."""
        n, size = len(self.languages), len(word) + 1
        sums = [[1.0] * n] + [[0.0] * n for _ in range(size)]
        scale = 0.0
        pieces, rest, each = self.pieces, self.pieces.get("", self.rest), range(n)
        scaled = 0
        for start, end, piece in cuts_of(word, self.automaton, pieces):
            if size > LONG_WORD and end - scaled >= LONG_WORD:
                # Keeps the sums of long words in the range of doubles: all that later cuts can start from is scaled.
                most = max(max(s) for s in sums[max(0, end - LONG_WORD) : end])
                if 0 < most < 1e-60:
                    for i in range(max(0, end - LONG_WORD), end + 1):
                        sums[i] = [v / most for v in sums[i]]
                    scale += math.log(most)
                scaled = end
            p, a, b = pieces.get(piece, rest), sums[start], sums[end]
            for k in each:
                b[k] += a[k] * p[k]
        return tuple(math.log(v) + scale if v > 0 else -700.0 + scale for v in sums[size])


def train(documents: DataFrame, vocabulary_path: str, sample: int = SAMPLE) -> Model:
    """Fit on text and language of documents outside the held-out fold; the driver gets at most ``MODEL_WORDS`` words
    and counts for each language, and the chosen ids are found by a top-n for each language."""
    known = documents.select("doc_id", "lang").dropna().filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    languages = sorted(r.lang for r in known.select("lang").distinct().collect())
    if not languages:
        return Model([], {}, ())
    smallest = Window.partitionBy("lang").orderBy("hash", "doc_id")
    chosen = known.select("lang", "doc_id", F.xxhash64("doc_id").alias("hash"))
    chosen = chosen.withColumn("n", F.row_number().over(smallest)).filter(F.col("n") <= sample).select("doc_id").distinct()
    rows = documents.select("doc_id", "lang", "text").dropna().join(F.broadcast(chosen), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for batch in batches:
            seen: Counter = Counter()
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                lang = lang.as_py()
                seen.update((lang, w) for w in words_of(text.as_py()))
            keys = list(seen)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.string()),
                    pa.array([k[1].decode("utf-8", "replace") for k in keys], pa.string()),
                    pa.array([seen[k] for k in keys], pa.int64()),
                ],
                names=["lang", "word", "n"],
            )

    totals = map_arrow(rows, count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), F.xxhash64("word"), "word")
    frequent = totals.withColumn("place", F.row_number().over(top)).filter(F.col("place") <= MODEL_WORDS).collect()
    words: dict[str, list[tuple[str, int]]] = {lang: [] for lang in languages}
    for r in frequent:
        words[r.lang].append((r.word, r.n))
    # Only pieces that occur in the words can get a probability, so only those are kept.
    automaton = matcher(vocabulary(vocabulary_path))
    every = set()
    for found in words.values():
        for word, _ in found:
            every.update(piece for _, (_, piece) in automaton.iter(START + word))
    small = matcher(sorted(every))
    fitted = {lang: fit_pieces(sorted(w), small, every) for lang, w in words.items()}
    mass = {lang: sum(n for _, n in w) for lang, w in words.items()}
    size = len(every) + 1
    rest = tuple(SMOOTHING / (mass[lang] + SMOOTHING * size) for lang in languages)
    pieces = {
        p: tuple((fitted[lang].get(p, 0.0) * mass[lang] + SMOOTHING) / (mass[lang] + SMOOTHING * size) for lang in languages)
        for p in sorted(every | {""})
    }
    return Model(languages, pieces, rest)


class WordTable:
    """Log probabilities of the words met, a row of a table each; emptied when full."""

    def __init__(self, model: Model):
        self.model, self.rows, self.known = model.ready(), np.zeros((1024, len(model.languages))), {}
        self.most = min(REMEMBERED, CELLS_REMEMBERED // max(1, len(model.languages)))

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        distinct = set(words)
        new = [w for w in distinct if w not in known]
        if len(known) + len(new) > self.most:
            known.clear()
            new = list(distinct)
        need = len(known) + len(new)
        if need > len(self.rows):
            grown = np.zeros((max(need, 2 * len(self.rows)), self.rows.shape[1]))
            grown[: len(known)] = self.rows[: len(known)]
            self.rows = grown
        for w in new:
            at = len(known)
            self.rows[at] = self.model.word(w.decode("utf-8", "replace"))
            known[w] = at
        return self.rows[np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))]


def predict_text(text: str | None, table: WordTable) -> tuple[str, float]:
    languages = table.model.languages
    words = words_of(text)
    if not words or not languages or not has_letter(text):
        return UNKNOWN, 0.0
    sums = table.of(words).sum(axis=0)
    shares = np.exp(sums - sums.max())
    best = int(np.argmax(sums))
    return languages[best], float(shares[best] / shares.sum())


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and its probability ``score`` for each whole text. No shuffle; the model's size is bounded
    by the vocabulary."""
    sent = df.sparkSession.sparkContext.broadcast(Model(model.languages, model.pieces, model.rest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        table = WordTable(sent.value)
        for batch in byte_slices(batches, text, SLICE_BYTES):
            found = [predict_text(t.as_py(), table) for t in batch.column(text)]
            yield with_columns(batch, lang_pred=pa.array([f[0] for f in found], pa.string()), score=pa.array([f[1] for f in found], pa.float64()))
        del table
        give_back()

    return map_arrow(df, run, schema_with(df, lang_pred="string", score="double"))
