"""Training documents that hold benchmark items, by a BM25 index of the items with block-max WAND.

The items are indexed once, by pairs of neighbouring words, of which chance matches are rare (an item of one word by that
word): each pair's list of items, with its BM25 weight in the item as a share of the weight of all the item's pairs, cut into
blocks with the largest weight of each. Every training text is read in passages that
overlap so that each place of an item's length lies whole within one, and every passage is a query: an item's score
is the share of its weight that the passage holds. WAND takes the pairs' lists in step, by item, and skips items that
the pairs met cannot bring to the threshold, and then blocks whose own maxima cannot. Passages whose pairs, all
together, stay below the threshold are passed over at once. What is retrieved is verified by word five-grams: a passage
holds an item if it has much of the whole item or nearly all of its question, or some of the question together with
some words of the answer. The three overlaps are columns, so that a stricter choice can be made later.

An item's answer is its last line if it has several lines; the rest is its question.

Defined cases: null and empty texts and items without words match nothing; items of fewer than five words have one
gram, the whole question; an item that occurs several times in a text is reported once, with its best overlap; repeated
rows give repeated results; a table without items gives none. Other columns of the documents are dropped.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import drop_held, map_arrow, small_batches
from threadloom.llm.toxicity import words_of

THRESHOLD = 0.4
QUESTION_OVERLAP = 0.3
ANSWER_OVERLAP = 0.3
# Of the five-grams of the whole item, or of the question, that are enough by themselves.
ITEM_OVERLAP = 0.5
QUESTION_ALONE = 0.8
GRAM = 5
K1, B = 1.2, 0.75
POSTINGS_BLOCK = 16
# Text of the items that one index holds; more items are taken in several passes, an index for each.
INDEX_BYTES = 16 * 1024**2


def grams(words: list[bytes]) -> set[tuple]:
    return {tuple(words[i : i + GRAM]) for i in range(max(1, len(words) - GRAM + 1))} if words else set()


class ItemIndex:
    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.questions, self.answers, self.wholes = [], [], [], []
        texts = []
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            lines = [w for line in text.split("\n") if (w := words_of(line))]
            self.ids.append(item)
            self.questions.append(grams([w for line in lines[:-1] for w in line] if len(lines) > 1 else words))
            self.answers.append(set(lines[-1]) if len(lines) > 1 else set())
            self.wholes.append(grams(words))
            texts.append(words)
        n = len(texts)
        self.longest = max(map(len, texts), default=0)
        mean = sum(map(len, texts)) / max(1, n)
        self.words = {w: i + 1 for i, w in enumerate(sorted({w for words in texts for w in words}))}  # 0: no word of an item
        lists: dict[int, list[tuple[int, float]]] = {}
        counted = [Counter(self.keys_of(words, alone=len(words) == 1).tolist()) for words in texts]
        df = Counter(k for counts in counted for k in counts)
        for i, (words, counts) in enumerate(zip(texts, counted, strict=True)):
            weights = {
                k: math.log(1 + (n - df[k] + 0.5) / (df[k] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
                for k, tf in counts.items()
            }
            whole = sum(weights.values())
            for k, weight in weights.items():
                lists.setdefault(k, []).append((i, weight / whole))
        self.terms = {k: t + 1 for t, k in enumerate(sorted(lists))}  # 0: no term of an item
        found = [lists[k] for k in sorted(lists)]
        self.sorted_keys = np.array([*sorted(lists), 1 << 62], dtype=np.int64)
        self.items = [[], *[[i for i, _ in f] for f in found]]
        self.weights = [[], *[[x for _, x in f] for f in found]]
        self.most = np.array([0.0, *[max(x for _, x in f) for f in found]])
        self.block_most = [[], *[[max(x for _, x in f[b : b + POSTINGS_BLOCK]) for b in range(0, len(f), POSTINGS_BLOCK)] for f in found]]
        self.alone = any(len(words) == 1 for words in texts)

    def keys_of(self, words: list[bytes], alone: bool) -> np.ndarray:
        """Keys of the pairs of neighbouring words, -1 where a word is in no item; ``alone``: of the words themselves."""
        ids = np.fromiter(map(self.words.get, words, repeat(0)), dtype=np.int64, count=len(words))
        if alone:
            return np.where(ids > 0, ids, -1)
        return np.where((ids[:-1] > 0) & (ids[1:] > 0), ids[:-1] * (len(self.words) + 1) + ids[1:], -1)

    def terms_of(self, words: list[bytes]) -> np.ndarray:
        """Term that begins at each place of a text, 0 for none."""
        def known(keys: np.ndarray) -> np.ndarray:
            at = np.searchsorted(self.sorted_keys, keys)
            return np.where(self.sorted_keys[at] == keys, at + 1, 0)

        pairs = np.append(known(self.keys_of(words, alone=False)), 0)
        if not self.alone:
            return pairs
        return np.stack([pairs, known(self.keys_of(words, alone=True))])

    def retrieve(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Items of at least ``threshold`` for the distinct ``terms``, by block-max WAND."""
        end = len(self.ids)
        cursors = [[self.items[t][0], 0, t] for t in terms]  # item, place in the list, term
        found = []
        while True:
            cursors = [c for c in cursors if c[0] < end]
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += self.most[t]
                if bound >= threshold - 1e-12:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # Move the lists up to the pivot's item, then see what the blocks they stand in can give.
            block_bound = 0.0
            for c in cursors[: pivot + 1]:
                self._advance(c, item)
                if c[0] < end:
                    block_bound += self.block_most[c[2]][c[1] // POSTINGS_BLOCK]
            if block_bound >= threshold - 1e-12:
                score = sum(self.weights[c[2]][c[1]] for c in cursors[: pivot + 1] if c[0] == item)
                if score >= threshold - 1e-12:
                    found.append((item, score))
                after = item + 1
            else:
                # No item before the end of the first of these blocks can reach the threshold without other lists.
                ends = [self._block_end(c) for c in cursors[: pivot + 1] if c[0] < end]
                ends += [c[0] for c in cursors[pivot + 1 :]]
                after = max(item + 1, min(ends, default=end))
            for c in cursors[: pivot + 1]:
                self._advance(c, after)

    def _block_end(self, cursor: list[int]) -> int:
        """First item behind the block that the cursor stands in."""
        items, at = self.items[cursor[2]], (cursor[1] // POSTINGS_BLOCK + 1) * POSTINGS_BLOCK
        return items[at - 1] + 1 if at <= len(items) else len(self.ids)

    def _advance(self, cursor: list[int], item: int) -> None:
        items = self.items[cursor[2]]
        while cursor[1] < len(items) and items[cursor[1]] < item:
            cursor[1] += 1
        cursor[0] = items[cursor[1]] if cursor[1] < len(items) else len(self.ids)

    def search(self, words: list[bytes], threshold: float) -> dict[int, tuple[float, float, float, float]]:
        """Verified items of a text: score and overlap of question, answer and whole item of each."""
        if not words or not self.longest:
            return {}
        terms = np.atleast_2d(self.terms_of(words))
        step = self.longest
        starts = np.arange(0, max(1, len(words) - step), step)
        sums = np.concatenate([[0.0], np.cumsum(self.most[terms].sum(axis=0))])
        ends = np.minimum(starts + 2 * step, len(words))
        out: dict[int, tuple[float, float, float, float]] = {}
        for i in np.flatnonzero(sums[ends] - sums[starts] >= threshold - 1e-9).tolist():
            start, stop = int(starts[i]), int(ends[i])
            distinct = np.unique(terms[:, start:stop])
            distinct = distinct[distinct > 0]
            if self.most[distinct].sum() < threshold - 1e-9:
                continue
            passage = words[start:stop]
            held = None
            for item, score in self.retrieve(distinct.tolist(), threshold):
                held = held or (grams(passage) | {tuple(passage[k : k + n]) for n in range(1, GRAM) for k in range(len(passage))}, set(passage))
                question = len(self.questions[item] & held[0]) / len(self.questions[item]) if self.questions[item] else 1.0
                answer = len(self.answers[item] & held[1]) / len(self.answers[item]) if self.answers[item] else 1.0
                whole = len(self.wholes[item] & held[0]) / len(self.wholes[item])
                both = question >= QUESTION_OVERLAP and answer >= ANSWER_OVERLAP
                if both or whole >= ITEM_OVERLAP or question >= QUESTION_ALONE:
                    best = out.get(item)
                    if best is None or (whole, question, score) > (best[3], best[1], best[0]):
                        out[item] = (score, question, answer, whole)
        return out


FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, item_overlap double"


def find(documents: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document and item that it holds. No shuffle: each index, of at most ``INDEX_BYTES`` of text, is
    broadcast, and the documents are read once for each."""
    spark = documents.sparkSession
    known = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = size // INDEX_BYTES + 1
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for part in range(parts):
        chosen = known.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        index = spark.sparkContext.broadcast(ItemIndex(sorted((r.item_id, r.text) for r in chosen.collect())))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            drop_held()
            known = index.value
            for batch in small_batches(batches):
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    rows += [(doc, known.ids[i], *scores) for i, scores in sorted(known.search(words_of(text), threshold).items())]
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                    names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "item_overlap"],
                )

        found = map_arrow(texts, run, FOUND)
        out = found if out is None else out.union(found)
    return out
