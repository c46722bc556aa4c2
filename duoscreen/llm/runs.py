"""Periodic runs of words by seed and extension along diagonals.

A run is a stretch of words with smallest period q that holds at least four periods and six words and cannot be
extended. Its words equal those q further on over max(3 q, 6 - q) places at least: the guaranteed overlap on
diagonal q. Periods are taken in classes low .. 2 low - 1, and each class seeds with grams of the least overlap in
it (5 words for period 1, then 6, 12, 24, ...). As such a gram is no shorter than the period, its next occurrence in
the run is exactly q further on, so neighbouring occurrences of a gram are all the pairs that a class has to look at,
never all pairs. A seed that the furthest place covered on its lag has passed is skipped; any other is
extended word by word both ways. Hashes only propose seeds, words decide.

Documents stay in their partitions: one pass, no shuffle, memory in proportion to the longest text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscreen.llm.common import mix64, pieces

#: Periods and words that a run holds at least.
PERIODS = 4
WORDS = 6

Run = tuple[int, int, int]


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common start of two arrays, read in growing pieces."""
    n, at, step = min(len(a), len(b)), 0, 32
    while at < n:
        unlike = np.flatnonzero(a[at : min(n, at + step)] != b[at : min(n, at + step)])
        if len(unlike):
            return at + int(unlike[0])
        at, step = at + step, step * 2
    return n


def _extended(ids: np.ndarray, at: np.ndarray, lag: np.ndarray) -> Iterator[Run]:
    """The maximal stretches through the seeds at places ``at`` of diagonals ``lag``, as start, length and period."""
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    edges = [*np.flatnonzero(np.concatenate([[True], lag[1:] != lag[:-1]])), len(at)] if len(at) else []
    for first, last in zip(edges, edges[1:]):
        q, k, furthest = int(lag[first]), first, 0
        while k < last:
            i = int(at[k])
            left = _agree(ids[:i][::-1], ids[: i + q][::-1])
            furthest = i + _agree(ids[i:], ids[i + q :])
            yield i - left, furthest - i + left + q, q
            k = max(k + 1, first + int(np.searchsorted(at[first:last], furthest)))


def runs(ids: np.ndarray) -> list[Run]:
    """Start, length and period of each run of a sequence of word numbers, by start and period."""
    found: list[Run] = []
    n, low = len(ids), 1
    if n < WORDS:
        return found

    def folded(parts: list[np.ndarray]) -> np.ndarray:
        size, total = min(map(len, parts)), np.uint64(0)
        for p in parts:
            total = mix64(p[:size] + total + np.uint64(0x9E3779B97F4A7C15))
        return total

    words = ids.astype(np.uint64)
    threes = folded([words, words[1:], words[2:]])
    grams, width = folded([threes, words[3:], words[4:]]), 3
    while max(WORDS, PERIODS * low) <= n:
        order = np.argsort(grams, kind="stable")
        same = np.flatnonzero(grams[order[1:]] == grams[order[:-1]])
        if not len(same):
            break  # longer grams do not recur either
        at, lag = order[same], order[same + 1] - order[same]
        fits = (lag >= low) & (lag < 2 * low)
        found += [r for r in _extended(ids, at[fits], lag[fits]) if r[1] >= max(WORDS, PERIODS * r[2])]
        low *= 2
        grams, width = folded([threes, threes[width:]]) if n >= 2 * width else np.zeros(0, np.uint64), 2 * width
        threes = grams
    return sorted(found, key=lambda r: (r[0], r[2]))


def may_repeat(ids: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Of texts laid end to end, the numbers of those in which some five words recur; others have no run."""
    if len(ids) < WORDS:
        return np.zeros(0, np.int64)
    total = own.astype(np.uint64)[: len(ids) - 4]
    for i in range(5):
        total = mix64(total + ids[i : len(ids) - 4 + i].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    inside = own[4:] == own[: len(own) - 4]
    grams, text = total[inside], own[: len(own) - 4][inside]
    order = np.argsort(grams)
    same = grams[order[1:]] == grams[order[:-1]]
    return np.unique(text[order[1:][same]])


def kept_words(n: int, found: list[Run]) -> np.ndarray:
    """Which words no run repeats: those outside all runs, and the first period of a run if no other run drops it."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs, best and collapsed of every row of ``docs`` (doc_id, text).

    runs: start, length and period (words from 0) by start, then period. best: the run with most periods, the
    smallest start and period among equals, null without a run. collapsed: the words that no run repeats, joined by one
    space. Words stand between ASCII blanks. A null text has no words, null ids stay null, repeated rows give a
    row each, an empty table gives an empty result; other columns are ignored.
    """
    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, best struct<start: long, length: long, period: long>, collapsed string"
    names, run = ["start", "length", "period"], pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text"):
            words = [t.split() for t in texts]
            sizes = np.array([len(w) for w in words], dtype=np.int64)
            number = defaultdict(count().__next__)
            ids = np.fromiter((number[w] for ws in words for w in ws), dtype=np.int64, count=int(sizes.sum()))
            starts = np.concatenate([[0], np.cumsum(sizes)])
            found: list[list[Run]] = [[] for _ in texts]
            for t in may_repeat(ids, np.repeat(np.arange(len(texts)), sizes)).tolist():
                found[t] = runs(ids[starts[t] : starts[t + 1]])
            best = [max(f, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if f else None for f in found]
            collapsed = [b" ".join([w for w, k in zip(ws, kept_words(len(ws), f).tolist()) if k] if f else ws) for ws, f in zip(words, found)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(sizes),
                    pa.array([[dict(zip(names, r)) for r in f] for f in found], pa.list_(run)),
                    pa.array([None if b is None else dict(zip(names, b)) for b in best], run),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "runs", "best", "collapsed"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(search, schema)
