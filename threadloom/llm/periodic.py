"""Runs of repeated words: maximal stretches of a text with a short period, and the text with each period kept once.

The candidate periods of a text of n words are tried on a harmonic grid: for period p every p-th place i (every
(least length - p)-th where that is more) is compared with place i + p. A run covers such a pair in full, so
the pair begins alike, and its longest common extension to the right and to the left gives the run's borders. That is
n * ln(n) extensions. One is answered with a difference cover: of the suffixes only those at sampled
places (4 of every 13) are sorted, by windows of 13 words and then by doubling; for any two places there is a shift of
fewer than 13 words that takes both to sampled ones, so these few words are compared, and what follows is the minimum of a
range of common prefixes of neighbouring sampled suffixes, from a sparse table. Texts in which no comparison reaches
sampled places need no sorting.

Several texts are handled at a time, parted by words that occur nowhere else, so that no extension leaves its text.
No shuffle; a task holds one batch of texts, or one text that is larger.

Defined cases: null and empty texts have no runs and collapse to empty text; a text is taken whole, whatever its length; repeated rows give
repeated rows; an empty table gives an empty one; columns beside the text are kept, and one called like an added column is replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import byte_slices, map_arrow, schema_with, with_columns

# Runs are at least so long, and hold their period at least twice.
LEAST_LENGTH = 12

# A difference cover of 13, whose differences take every value modulo 13.
COVER_SIZE = 13
COVER = (0, 1, 3, 9)

# Bytes of text handled at a time, and pairs of the grid.
SLICE_BYTES = 4 * 1024**2
GRID_PAIRS = 1 << 20

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"

_SLOT = np.full(COVER_SIZE, -1)
_SLOT[list(COVER)] = np.arange(len(COVER))
_SHIFT = np.array([[min(d for d in range(COVER_SIZE) if (a + d) % COVER_SIZE in COVER and (b + d) % COVER_SIZE in COVER) for b in range(COVER_SIZE)] for a in range(COVER_SIZE)])


def compare_few(words: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common words from the two places on, up to the shift that takes both to sampled places, and whether all are equal."""
    shift = _SHIFT[left % COVER_SIZE, right % COVER_SIZE]
    same = np.zeros(len(left), dtype=np.int64)
    active = np.flatnonzero(shift > 0)
    step = 0
    while len(active):
        active = active[words[left[active] + step] == words[right[active] + step]]
        step += 1
        same[active] = step
        active = active[shift[active] > step]
    return same, same == shift


class CoverLce:
    """Longest common extensions to the right between places of ``words``, whose last word occurs only once."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words = np.concatenate([words, np.zeros(2 * COVER_SIZE, dtype=words.dtype)])
        places = (np.arange(0, n, COVER_SIZE)[:, None] + np.array(COVER)).ravel()
        # The grid of sampled places is whole, so that a place has its index by arithmetic; the few beyond the end hold zeros.
        self.words = np.concatenate([self.words, np.zeros(COVER_SIZE, dtype=words.dtype)])
        bits = max(1, int(words.max()).bit_length())
        per = 62 // bits
        keys = []
        for start in range(0, COVER_SIZE, per):
            key = np.zeros(len(places), dtype=np.int64)
            for d in range(start, min(start + per, COVER_SIZE)):
                key = key << bits | self.words[places + d]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
        levels, width = [self._ranks(order, fresh)], COVER_SIZE
        inside = places < n
        while True:
            rank = levels[-1]
            ends = np.append(np.flatnonzero(fresh)[1:], len(order))
            starts = np.flatnonzero(fresh)
            tied = np.repeat(ends - starts > 1, ends - starts)
            # Only places beyond the end may stay tied; nobody asks for them.
            if not (tied & inside[order]).any():
                break
            at = np.flatnonzero(tied)
            who = order[at]
            after = who + len(COVER) * (width // COVER_SIZE)
            following = np.where(after < len(rank), rank[np.minimum(after, len(rank) - 1)] + 1, 0)
            key = rank[who].astype(np.int64) << 32 | following
            by = np.argsort(key, kind="stable")
            order = order.copy()
            order[at] = who[by]
            fresh = fresh.copy()
            fresh[at[1:]] |= key[by][1:] != key[by][:-1]
            levels.append(self._ranks(order, fresh))
            width *= 2
            if width > 2 * (n + COVER_SIZE):
                break
        self.rank = np.empty(len(order), dtype=np.int64)
        self.rank[order] = np.arange(len(order))
        self._table(places, order, levels)

    @staticmethod
    def _ranks(order: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        rank = np.empty(len(order), dtype=np.int32)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        return rank

    def _table(self, places: np.ndarray, order: np.ndarray, levels: list[np.ndarray]) -> None:
        """Sparse table over the common prefixes of neighbouring sampled suffixes, which the levels of the sort give."""
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = np.maximum(a, b) < len(order)
            same = inside.copy()
            same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
            common[same] += COVER_SIZE << k
            a[same] += len(COVER) << k
            b[same] += len(COVER) << k
        left, right = places[order[:-1]] + common, places[order[1:]] + common
        active = np.flatnonzero(np.maximum(left, right) < len(self.words) - 1)
        for _ in range(COVER_SIZE):
            active = active[np.maximum(left[active], right[active]) < len(self.words)]
            active = active[self.words[left[active]] == self.words[right[active]]]
            common[active] += 1
            left[active] += 1
            right[active] += 1
        self.table = [common.astype(np.int32)]
        span = 1
        while 2 * span <= len(common):
            before = self.table[-1]
            self.table.append(np.minimum(before[:-span], before[span:]))
            span *= 2

    def extend(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of words that are alike from the places ``left`` and ``right`` (never the same place) on."""
        same, through = compare_few(self.words, left, right)
        todo = np.flatnonzero(through)
        a, b = left[todo] + same[todo], right[todo] + same[todo]
        a, b = (self.rank[x // COVER_SIZE * len(COVER) + _SLOT[x % COVER_SIZE]] for x in (a, b))
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        least = np.empty(len(todo), dtype=np.int64)
        for k in np.unique(level):
            at = level == k
            row = self.table[k]
            least[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(k))])
        same[todo] += least
        return same


class _Extensions:
    """Extensions to the right and to the left between places of several texts; only texts that need it are sorted."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.words, self.back, self.starts, self.ends = words, words[::-1], starts, ends
        self.sorted = np.zeros(len(starts), dtype=bool)
        self.offset = np.zeros(len(starts), dtype=np.int64)

    def _sort(self, texts: np.ndarray) -> None:
        self.sorted[texts] = True
        chosen = np.flatnonzero(self.sorted)
        # Each text with the parting words before and after it, which occur once: in front a new one.
        sizes = self.ends[chosen] - self.starts[chosen] + 1
        at = np.cumsum(sizes) - sizes
        self.offset[chosen] = at - self.starts[chosen] + 1
        from_ = np.repeat(self.starts[chosen] - at, sizes) + np.arange(sizes.sum())
        taken = np.concatenate([[0], self.words[from_]])
        self.right, self.left = CoverLce(taken), CoverLce(taken[::-1])
        self.length = len(taken)

    def both(self, text: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words alike from i and j on, and before i and j."""
        n = len(self.words)
        after, deep_after = compare_few(self.words, i, j)
        before, deep_before = compare_few(self.back, n - i, n - j)
        deep = np.flatnonzero(deep_after | deep_before)
        if len(deep):
            texts = np.unique(text[deep])
            if not self.sorted[texts].all():
                self._sort(texts)
            a, b = i[deep] + self.offset[text[deep]], j[deep] + self.offset[text[deep]]
            after[deep] = self.right.extend(a, b)
            before[deep] = self.left.extend(self.length - a, self.length - b)
        return after, before


def _grid(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, period) of the harmonic grid of all texts, some pairs at a time."""
    n = ends - starts
    periods = np.where(n >= LEAST_LENGTH, n // 2, 0)
    # Texts in runs whose (text, period) rows are few enough to hold.
    bounds = np.searchsorted(np.cumsum(periods), np.arange(0, periods.sum() + GRID_PAIRS, GRID_PAIRS))
    for first, last in zip(bounds, np.append(bounds[1:], len(n)), strict=True):
        some = np.arange(first, last)
        text = np.repeat(some, periods[some])
        period = np.arange(len(text)) - np.repeat(np.cumsum(periods[some]) - periods[some], periods[some]) + 1
        step = np.maximum(period, LEAST_LENGTH - period)
        pairs = (n[text] - period - 1) // step + 1
        total = np.cumsum(pairs)
        low = 0
        while low < len(text):
            high = max(low + 1, int(np.searchsorted(total, total[low] - pairs[low] + GRID_PAIRS, "right")))
            number = pairs[low:high]
            row = np.repeat(np.arange(low, high), number)
            k = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            yield text[row], starts[text[row]] + k * step[row], period[row]
            low = high


def runs_of(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(text, start, end, period) of every run, in that order.

    Text t is ``words[starts[t]:ends[t]]``; before the first and after each text stands a word that occurs nowhere else.
    A stretch is found with every multiple of its period that fits; the least period stays.
    """
    extensions, found = _Extensions(words, starts, ends), [np.zeros((0, 4), dtype=np.int64)]
    for text, i, p in _grid(starts, ends):
        alike = words[i] == words[i + p]
        text, i, p = text[alike], i[alike], p[alike]
        after, before = extensions.both(text, i, i + p)
        low, high = i - before, i + p + after
        good = high - low >= np.maximum(LEAST_LENGTH, 2 * p)
        rows = np.stack([text, low, high, p], axis=1)[good]
        found.append(_least_period(rows))
    rows = _least_period(np.concatenate(found))
    rows[:, 1:3] -= starts[rows[:, 0], None]
    return rows


def _least_period(rows: np.ndarray) -> np.ndarray:
    rows = rows[np.lexsort(rows.T[::-1])]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    return rows[first]


def _runs_and_rest(texts: list[bytes | None]) -> tuple[np.ndarray, list[str]]:
    """Runs of the texts, and each text without the words that a run repeats."""
    number: dict[bytes, int] = defaultdict(count(1).__next__)
    split = [t.split() if t else [] for t in texts]
    sizes = np.array([len(s) for s in split], dtype=np.int64)
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes
    words = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, dtype=np.int64)
    for s, start, end in zip(split, starts, ends, strict=True):
        words[start:end] = np.fromiter(map(number.__getitem__, s), np.int64, len(s))
    apart = np.append(0, ends)
    words[apart] = len(number) + 1 + np.arange(len(apart))
    runs = runs_of(words, starts, ends)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, starts[runs[:, 0]] + runs[:, 1] + runs[:, 3], 1)
    np.add.at(change, starts[runs[:, 0]] + runs[:, 2], -1)
    dropped = np.cumsum(change) > 0
    rest = []
    for s, start, end in zip(split, starts, ends, strict=True):
        gone = dropped[start:end]
        rest.append(b" ".join([w for w, g in zip(s, gone.tolist(), strict=True) if not g] if gone.any() else s).decode())
    return runs, rest


def find_runs(df: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """``df`` with all runs of each text, by start and period, and the text in which each run keeps its first period.

    Words are parted by ASCII white space and numbered from 0; the collapsed text joins words by one blank.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, text, SLICE_BYTES):
            found, rest = _runs_and_rest(batch.column(text).cast(pa.binary()).to_pylist())
            found = found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]
            offsets = np.searchsorted(found[:, 0], np.arange(batch.num_rows + 1)).astype(np.int32)
            values = pa.StructArray.from_arrays(
                [pa.array(found[:, 1]), pa.array(found[:, 2] - found[:, 1]), pa.array(found[:, 3])], ["start", "length", "period"]
            )
            yield with_columns(batch, **{runs: pa.ListArray.from_arrays(pa.array(offsets), values), collapsed: pa.array(rest, pa.string())})

    return map_arrow(df, rows, schema_with(df, **{runs: RUNS, collapsed: "string"}))


def longest_run(runs: str | Column) -> Column:
    """The run of greatest length, of these the one with the smallest start, then the smallest period; null without runs."""
    runs = F.col(runs) if isinstance(runs, str) else runs
    ordered = F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    best = F.array_max(ordered)
    return F.when(
        F.size(runs) > 0,
        F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")),
    )
