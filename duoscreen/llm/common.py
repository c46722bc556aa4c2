"""Helpers shared by the operators: stage tables, word splitting in numpy, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscreen.session import stage

__all__ = ["components", "hidden_names", "keyed", "mix64", "pieces", "shared", "spared", "stage", "word_grams", "word_hashes", "word_starts"]

#: Text bytes that a task works on at a time; a longer text makes a piece of its own.
PIECE_BYTES = 1 << 20

_WORD = np.zeros(256, dtype=bool)
_WORD[128:] = True
for _span in (b"az", b"AZ", b"09"):
    _WORD[_span[0] : _span[1] + 1] = True


def hidden_names(docs: DataFrame, *used: str) -> dict[str, str]:
    """New names for the columns of ``docs`` that an operator could take for its own: those in ``used`` and all that begin with __."""
    taken, out = {c.lower() for c in docs.columns}, {}
    for i, c in enumerate(docs.columns):
        if c.startswith("__") or c.lower() in used:
            name = f"hidden_{i}"
            while name in taken:
                name += "_"
            taken.add(name)
            out[c] = name
    return out


def spared(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator that returns the columns of its first argument, also where these have names of its own."""

    @wraps(operator)
    def run(docs: DataFrame, *args: Any, **options: Any) -> DataFrame:
        names = hidden_names(docs)
        return operator(docs.withColumnsRenamed(names), *args, **options).withColumnsRenamed({v: k for k, v in names.items()})

    return run


def pieces(batches: Iterator[pa.RecordBatch], column: str, size: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches of about ``size`` text bytes, with their texts as UTF-8 (null: empty)."""
    for batch in batches:
        texts = batch.column(column).cast(pa.large_binary())
        lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), dtype=np.int64)
        ends = np.cumsum(lengths)
        first = 0
        while first < len(lengths):
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + size, side="right")))
            part = batch.slice(first, last - first)
            yield part, [x or b"" for x in texts.slice(first, last - first).to_pylist()]
            first = last


def shared(spark: SparkSession, value: object) -> Callable[[], Any]:
    """Broadcast a value of the package's own classes; call the result on an executor to get it."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(sent.value)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix generator over unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_starts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of ASCII letters, digits and bytes of other scripts."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _WORD[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word from its bytes and their places."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    power = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, dtype=np.uint64))
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    place = at - np.repeat(starts, lengths)
    terms = (data[at].astype(np.uint64) + np.uint64(1)) * power[place]
    return mix64(np.add.reduceat(terms, np.concatenate([[0], np.cumsum(lengths)[:-1]])))


def word_grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words; the whole sequence if it is shorter, nothing if it is empty."""
    n = min(n, len(words))
    if not n:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        total = mix64(total + words[i : len(words) - n + 1 + i])
    return total


def keyed(df: DataFrame) -> tuple[int, int]:
    """Count of the rows and a sum of hashes, to see whether a table still changes."""
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).bitwiseAND(F.lit((1 << 40) - 1)))).first()
    return row[0], row[1] or 0


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable node of each node that has a link.

    links: columns ``a`` and ``b``, in any direction, repeats allowed. Alternates large-star and small-star
    steps; each round is a written table, so the lineage stays short. A node with many links costs a skewed
    equi join against one row for each node, which adaptive execution can split.
    """
    edges = links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stage(edges, "links")
    seen = keyed(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        wide = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = wide.groupBy("u").agg(F.min("v").alias("m"))
        narrow = wide.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        edges = stage(narrow.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = keyed(edges)
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now
    raise RuntimeError(f"components still change after {rounds} rounds")
