"""Toxic passages by maximum-scoring segments of word log-odds.

A word's score is how much likelier it stands in a toxic document than in another: the log-odds ratio with a Dirichlet
prior that follows the corpus, for the word or, where the word is rare, for its beginning, so that inflected forms share
what is known of their stem. Scores that could be chance count as nothing, and every word costs a little, so that the
sum over ordinary text falls. One linear scan finds all maximal segments of positive sum. For sums with such a falling
trend the largest one in ordinary text of N words follows an extreme-value law: a segment of score S is expected
N * exp(-lambda * S) times, where lambda solves sum(p(s) * exp(lambda * s)) = 1 over the scores of ordinary words. Segments
expected less than once in twenty texts are reported, and the document's score is the probability that ordinary text
of its length has none as good as its best.

Fitting uses at most ``sample`` labelled documents, the ones whose hashed id is smallest, each distinct text once.

Defined cases: null and empty text and text without words score 0; null labels and null ids are not learned from;
a document with several labels counts as toxic if one says so; with no labels, or labels of one kind, every
score is 0. Repeated rows give repeated rows; other columns are kept, those named like an added one are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import SLICE_BYTES, byte_slices, drop_held, give_back, map_arrow, schema_with, with_columns
from threadloom.llm.licenses import AS_WORDS

SAMPLE = 40_000
MODEL_UNITS = 50_000
PREFIXES = (5, 4)
PRIOR_SHARE = 0.2
LEAST_DOCUMENTS = 3  # toxic ones, that a toxic unit has to stand in
LEAST_Z = 3.0
WORD_COST = 0.2
SIGNIFICANT = 0.05
THRESHOLD = 0.7
REMEMBERED = 500_000


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(AS_WORDS).split() if text else []


def units_of(word: bytes) -> list[str]:
    """The word and its beginnings, longest first; a beginning ends in a mark that no word holds."""
    text = word.decode("utf-8", "replace")
    return [text, *[text[:n] + "~" for n in PREFIXES if len(text) >= n]]


@dataclass(frozen=True)
class Model:
    units: dict[str, float]
    decay: float  # lambda of the extreme-value law

    def word_score(self, word: bytes) -> float:
        for unit in units_of(word):
            if unit in self.units:
                return self.units[unit] - WORD_COST
        return -WORD_COST


def significant_units(counts: DataFrame, other: int, toxic: int) -> DataFrame:
    """(unit, ratio, z) of the units whose use differs beyond chance, for sums ``other`` and ``toxic`` of all counts.

    The log-odds ratio has a Dirichlet prior worth ``PRIOR_SHARE`` of the observations, dealt out like the units of
    both kinds together. A toxic unit has to stand in ``LEAST_DOCUMENTS`` toxic documents, and may stand in others: how
    much that weighs is left to its ratio.
    """
    prior = (F.col("other") + F.col("toxic")) * PRIOR_SHARE
    weight = (other + toxic) * PRIOR_SHARE
    a, b = F.col("other") + prior, F.col("toxic") + prior
    ratio = F.log(b / (toxic + weight - b)) - F.log(a / (other + weight - a))
    found = counts.select("unit", "toxic", ratio.alias("ratio"), (F.abs(ratio) / F.sqrt(1 / a + 1 / b)).alias("z"))
    return found.filter((F.col("z") >= LEAST_Z) & ((F.col("ratio") < 0) | (F.col("toxic") >= LEAST_DOCUMENTS))).drop("toxic")


def decay_of(scores: Counter) -> float:
    """The positive solution of sum(p * exp(x * score)) = 1, for scores whose mean is negative. A positive score that
    ordinary words never had is taken to be half as frequent as one seen once."""
    total = sum(scores.values())
    if not total:
        return 1.0
    if not any(s > 0 for s in scores):
        scores = scores + Counter({3.0: 0.5})
    if sum(s * n for s, n in scores.items()) >= 0:
        return 0.05
    low, high = 0.0, 1.0
    value = lambda x: sum(n * math.exp(min(600.0, x * s)) for s, n in scores.items()) - total
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return high


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal segments (start, end, sum) of positive sum, in one pass.

    Each candidate keeps the sum of everything before it and up to its end; a new one is joined with the last
    candidate that begins lower and ends no higher, until there is none.
    """
    found: list[list] = []  # start, end, sum before, sum at its end
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, end, low, high = i, i + 1, before, total
        while found:
            j = len(found) - 1
            # candidates that do not begin below this one's start cannot be joined to it
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
        j = len(found) - 1
        while j >= 0 and found[j][2] >= low:
            j = found[j][4]
        found.append([start, end, low, high, j])
    return [(a, b, high - low) for a, b, low, high, _ in found]


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """At most ``sample`` labelled documents outside the held-out fold, by smallest hash of the id; the chosen ids are
    broadcast, so the texts are not shuffled."""
    known = labels.select("doc_id", F.col(label).alias("label")).dropna()
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on labelled documents. Units are counted in the tasks and summed in a shuffle; only units that can pass
    the test of chance, ``MODEL_UNITS`` at most, reach the driver."""
    # A text that is labelled both ways counts as toxic, whatever the order of its rows.
    rows = labelled_sample(documents, labels, label, sample).dropna().groupBy("text").agg(F.max("label").cast("int").alias("label"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, kind in zip(batch.column(0), batch.column(1), strict=True):
                units = {u for w in set(words_of(text.as_py())) for u in units_of(w)}
                seen[1 if kind.as_py() == 1 else 0].update(units)
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([seen[0][u] for u in names], pa.int64()), pa.array([seen[1][u] for u in names], pa.int64())],
                names=["unit", "other", "toxic"],
            )

    counts = map_arrow(rows, count, "unit string, other long, toxic long").groupBy("unit").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    counts = counts.persist()
    sums = counts.agg(F.sum("other"), F.sum("toxic")).first()
    if not sums[0] or not sums[1]:
        counts.unpersist()
        return Model({}, 1.0)
    kept = significant_units(counts, sums[0], sums[1])
    units = {r.unit: max(-1.0, r.ratio) for r in kept.orderBy(F.desc("z"), "unit").limit(MODEL_UNITS).collect()}
    counts.unpersist()
    draft = Model(units, 1.0)

    def ordinary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores: Counter = Counter()
            for text, kind in zip(batch.column(0), batch.column(1), strict=True):
                if kind.as_py() == 0:
                    scores.update(round(draft.word_score(w), 1) for w in words_of(text.as_py()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(scores), pa.float64()), pa.array(list(scores.values()), pa.int64())], names=["score", "n"]
            )

    found = map_arrow(rows, ordinary, "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).collect()
    return Model(units, decay_of(Counter({r.score: r.n for r in found})))


def score_text(text: str | None, model: Model, cache: dict[bytes, float]) -> tuple[float, list[dict]]:
    words = words_of(text)
    scores = list(map(cache.__getitem__, words))
    if not scores or max(scores) <= 0:
        return 0.0, []
    passages, best = [], 0.0
    for start, end, total in maximal_segments(scores):
        expected = len(words) * math.exp(-model.decay * total)
        best = max(best, math.exp(-expected))
        if expected <= SIGNIFICANT:
            passages.append({"first_word": start, "last_word": end - 1, "score": total, "expected": expected})
    return best, passages


class WordScores(dict):
    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word: bytes) -> float:
        value = self.model.word_score(word)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) < 64:
            self[word] = value
        return value


PASSAGES = "array<struct<first_word: long, last_word: long, score: double, expected: double>>"


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``score``, ``predicted`` and the significant ``passages`` of each whole text. No shuffle; the model has
    at most ``MODEL_UNITS`` entries."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        learned = sent.value
        cache = WordScores(learned)
        for batch in byte_slices(batches, text, SLICE_BYTES):
            found = [score_text(t.as_py(), learned, cache) for t in batch.column(text)]
            scores = [f[0] for f in found]
            yield with_columns(
                batch,
                score=pa.array(scores, pa.float64()),
                predicted=pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()),
                passages=pa.array([f[1] for f in found], passage),
            )
        del cache
        give_back()

    return map_arrow(df, run, schema_with(df, score="double", predicted="int", passages=PASSAGES))
