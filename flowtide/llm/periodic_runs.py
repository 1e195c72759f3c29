"""Periodic runs of words, on a harmonic grid.

A run of period p and at least e * p words covers e neighbouring points of the grid 0, p, 2p, ... So for every period p each
pair of neighbouring grid points is asked how far the words at both agree forward and backward; both answers together are a
maximal stretch of period p. Over all periods that is n + n/2 + n/3 + ... questions. Answers are minima over ranges (RMQ) of the
common prefixes of neighbouring suffixes in a suffix array of the words, and in one of the reversed words. Pairs whose
words, or some words after them, differ can't lie in a run at its first grid point and aren't asked; a text of which no pair is left gets no
suffix array. A stretch found under several periods keeps the smallest, which is its smallest period: a stretch of four
periods has no other smallest one than a divisor.

Texts are handled in Arrow batches of BATCH_BYTES, a longer text by itself, with some 250 bytes of memory a word at most where it has runs.

Cases: null text has no words and no runs, its collapsed text is empty; repeated rows are handled each; an empty table gives no rows;
other columns are ignored. A null doc_id is passed to `order` as None.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import session, texts
from .words import Words, batches, split

#: Fewest words of a run, fewest periods, and words after a grid point that are compared before the suffix array is asked.
MIN_WORDS, MIN_PERIODS, PEEK = 6, 4, 8
BATCH_BYTES = 4 << 20

RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Suffixes:
    """Common prefixes of any two suffixes of x, whose last value is nowhere else: suffix array by prefix doubling, RMQ by a sparse table."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        order = np.argsort(x, kind="stable")
        rank = self._ranks(x[order], order, np.arange(n), np.empty(n, np.int32))
        levels, k = [rank], 1  # equal ranks at level i: equal first 2**i values
        while True:
            slots = np.flatnonzero(self._tied(rank[order]))
            if not len(slots):
                break
            own = order[slots]
            key = rank[own].astype(np.int64) * n + rank[own + k]
            by = np.argsort(key, kind="stable")
            order[slots] = own[by]
            rank = self._ranks(key[by], own[by], slots, rank.copy())
            levels.append(rank)
            k *= 2
        self.rank = rank
        a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, n - 1), np.int32)
        for i in range(len(levels) - 1, -1, -1):
            same = levels[i][a] == levels[i][b]
            common[same] += 1 << i
            a[same] += 1 << i
            b[same] += 1 << i
        self.least = [common]
        while len(self.least[-1]) > 1 << (len(self.least) - 1):
            low, step = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(low[:-step], low[step:]))

    @staticmethod
    def _ranks(key: np.ndarray, at: np.ndarray, slots: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Gives places `at`, sorted by key, the slot of the first place with the same key."""
        fresh = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        rank[at] = np.maximum.accumulate(np.where(fresh, slots, 0))
        return rank

    @staticmethod
    def _tied(ranks: np.ndarray) -> np.ndarray:
        same = ranks[1:] == ranks[:-1]
        return np.append(same, False) | np.append(False, same)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many values agree from i and from j on, i and j being different."""
        low, high = np.minimum(self.rank[i], self.rank[j]), np.maximum(self.rank[i], self.rank[j])
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            own = level == k
            out[own] = np.minimum(self.least[k][low[own]], self.least[k][high[own] - (1 << k)])
        return out


def grid_pairs(x: np.ndarray, longest: int, min_words: int, min_periods: int) -> list[tuple[int, np.ndarray]]:
    """For each period the grid points that may be the first of a run: (period, places)."""
    out = []
    for p in range(1, longest // min_periods + 1):
        grid = x[::p]
        equal = grid[:-1] == grid[1:]
        pairs = max(min_words, min_periods * p) // p - 1
        ok = np.flatnonzero(equal)
        for d in range(1, pairs):
            ok = ok[ok + d < len(equal)]
            ok = ok[equal[ok + d]]
        ok = ok * p
        for d in range(1, min(PEEK, (min_periods - 2) * p - 1) + 1):
            if not len(ok):
                break
            ok = ok[ok + p + d < len(x)]
            ok = ok[x[ok + d] == x[ok + p + d]]
        if len(ok):
            out.append((p, ok))
    return out


def runs_of(x: np.ndarray, longest: int, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> np.ndarray:
    """Rows (start, length, period) of all runs in x, by start and period. x: texts, each followed by a value that is nowhere else."""
    pairs = grid_pairs(x, longest, min_words, min_periods)
    if not pairs:
        return np.zeros((0, 3), np.int64)
    # Only texts with a pair are sorted, each by its own values.
    ends = np.flatnonzero(x < 0)
    places = np.concatenate([at for _, at in pairs])
    period = np.repeat([p for p, _ in pairs], [len(at) for _, at in pairs])
    text = np.searchsorted(ends, places)
    inside = places + period < ends[text]
    places, period, text = places[inside], period[inside], text[inside]
    if not len(places):
        return np.zeros((0, 3), np.int64)
    asked = np.unique(text)
    begin = np.append(0, ends[:-1] + 1)
    size = ends[asked] + 1 - begin[asked]
    first = np.cumsum(size) - size
    own = np.repeat(begin[asked] - first, size) + np.arange(int(size.sum()))
    values = np.unique(x[own].astype(np.int64) + np.repeat(np.arange(len(asked)) << 32, size), return_inverse=True)[1].astype(np.int32)
    n = len(values)
    i = places - begin[text] + first[np.searchsorted(asked, text)]
    ahead = Suffixes(values).common(i, i + period)
    back = np.zeros(len(i), np.int64)
    inner = i > 0
    turned = np.append(values[-2::-1], values[-1])  # the last value stays last
    back[inner] = Suffixes(turned).common(n - 1 - i[inner], n - 1 - i[inner] - period[inner])
    start, length = places - back, back + ahead + period
    ok = length >= np.maximum(min_words, min_periods * period)
    rows = np.stack([start, length, period], axis=1)[ok]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    fresh = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)) if len(rows) else np.zeros(0, bool)
    rows = rows[fresh]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _joined(words: Words, taken: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes of the words `taken`, a space after each, and where each begins (and the end)."""
    size = words.end[taken] - words.start[taken] + 1
    stop = np.append(0, np.cumsum(size))
    at = np.repeat(words.start[taken] - stop[:-1], size) + np.arange(int(stop[-1]))
    out = np.append(words.data, np.uint8(0x20))[at]
    out[stop[1:] - 1] = 0x20
    return out.tobytes(), stop


def periodic_runs(docs: DataFrame, order: Callable[[int | None, int], np.ndarray | None] | None = None, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """For each document: n_words, its runs by start and period, and the text without what repeats a run's first period.

    `order` may give, for a doc_id and its number of words, the places of the words to take instead of 0 .. n - 1.
    """
    if min_periods < 2:
        raise ValueError("a run has two periods or more")
    session(docs)

    def rows(it):
        for batch in batches(it, "text", BATCH_BYTES):
            words = split(batch["text"])
            first = words.first
            place = np.arange(len(words.start))
            if order:
                for i, (doc, a, b) in enumerate(zip(batch["doc_id"].to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    if (other := order(doc, b - a)) is not None:
                        place[a:b] = a + other
            data, start, _ = words.joined()
            offsets = np.append(start, len(data)).astype(np.int64)
            each = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            value = each.dictionary_encode().indices.to_numpy()
            counts = words.counts()
            x = np.empty(len(place) + len(counts), np.int32)
            ends = first[1:] + np.arange(len(counts))
            inside = np.ones(len(x), bool)
            inside[ends] = False
            x[inside] = value[place]
            x[ends] = -1 - np.arange(len(counts))
            found = runs_of(x, int(counts.max()), min_words, min_periods)
            of = np.searchsorted(ends, found[:, 0])
            begin = found[:, 0] - of  # as a word of the batch
            gone = np.zeros(len(place) + 1, np.int32)
            np.add.at(gone, begin + found[:, 2], 1)
            np.add.at(gone, begin + found[:, 1], -1)
            kept = np.cumsum(gone[:-1]) == 0
            text, stop = _joined(words, place[kept])
            cut = stop[np.append(0, np.cumsum(kept))[first]].tolist()
            to = np.searchsorted(of, np.arange(len(counts) + 1)).astype(np.int32)
            columns = [begin - first[:-1][of], found[:, 1], found[:, 2]]
            yield pa.record_batch({
                "doc_id": batch["doc_id"],
                "n_words": pa.array(counts, pa.int64()),
                "runs": pa.ListArray.from_arrays(pa.array(to), pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["start", "length", "period"])),
                "collapsed": pa.array([text[a : max(a, b - 1)] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()).cast(pa.string()),
            })

    return texts(docs).mapInArrow(rows, RUNS)
