"""Benchmark decontamination by SimHash of item-sized windows.

Every window of a document that has as many words as a benchmark item and holds enough of the shingles of items of that
size gets a SimHash: for a similarity of s, two windows of m and n shingles share at least s (m + n) / (1 + s), so with fewer
known ones no item can match. A multi-index over byte blocks of the item fingerprints finds all items of that size
within ``radius`` bits: at such a distance some block differs in at most ``radius // 8`` bits. The weighted Jaccard
similarity of the shingles, repeats counted, verifies each candidate. At a similarity of 0.8 fingerprints differ in 9 bits
on average (standard deviation 2.8); of 800,000 random pairs at exactly 0.8, of 9 to 60 shingles, none was beyond 23 bits.

Documents stay where they are; the distinct texts of the benchmark come to them in blocks of a bounded number of bytes,
one scan for each, and item ids are joined to what was found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duoscreen.llm.common import pieces, spared, stage, word_grams, word_hashes, word_starts
from duoscreen.session import discard

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23
#: Bytes of distinct item texts that are sent to the tasks at once; an item is never split.
BLOCK_BYTES = 1 << 22
#: Windows times items that are compared at once.
CELLS = 1 << 22

_BLOCKS = 8


def _words(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, dtype=np.uint8)
    return word_hashes(data, *word_starts(data))


def _bits(grams: np.ndarray) -> np.ndarray:
    """One row of +1 and -1 for each shingle."""
    return 2 * np.unpackbits(grams[:, None].view(np.uint8), axis=1, bitorder="little").astype(np.int32) - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller over sum of the larger counts of each shingle."""
    keys, n = np.unique(a, return_counts=True)
    others, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(keys, others, assume_unique=True, return_indices=True)
    both = np.minimum(n[i], m[j]).sum()
    return float(both / (len(a) + len(b) - both))


@dataclass
class Size:
    """All items of one number of words: fingerprints, and for each block value the items nearly equal in it."""

    n_words: int
    items: list[str]
    grams: list[np.ndarray]
    prints: np.ndarray = field(init=False)
    blocks: np.ndarray = field(init=False)

    def index(self, radius: int) -> None:
        self.prints = np.concatenate([_packed(_bits(g).sum(axis=0, keepdims=True)) for g in self.grams])
        own = self.prints[:, None].view(np.uint8)
        values = np.arange(256, dtype=np.uint8)
        self.blocks = np.bitwise_count(values[None, :, None] ^ own.T[:, None, :]) <= radius // _BLOCKS


class Index:
    """The items of one block of the benchmark by size, and which items hold each shingle."""

    def __init__(self, items: list[tuple[str, bytes]], radius: int):
        self.radius = radius
        self.sizes: dict[int, Size] = {}
        pairs = []
        for item, text in items:
            words = _words(text)
            if len(words):
                grams = word_grams(words, SHINGLE)
                size = self.sizes.setdefault(len(words), Size(len(words), [], []))
                size.items.append(item)
                size.grams.append(grams)
                pairs.append(np.stack([np.unique(grams), np.full(len(np.unique(grams)), len(words), dtype=np.uint64)]))
        for size in self.sizes.values():
            size.index(radius)
        both = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((2, 0), np.uint64)
        order = np.lexsort((both[1], both[0]))
        self.shingles, self.n_words = both[0][order], both[1][order].astype(np.int64)
        self.known = np.zeros(1 << 20, dtype=bool)
        self.known[(self.shingles & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.lengths = sorted({min(SHINGLE, n) for n in self.sizes})

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose shingle an item holds, with the size of the item; one row for each such size."""
        maybe = np.flatnonzero(self.known[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
        low = np.searchsorted(self.shingles, grams[maybe], side="left")
        n = np.searchsorted(self.shingles, grams[maybe], side="right") - low
        at = np.repeat(maybe, n)
        step = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        return at, self.n_words[np.repeat(low, n) + step]

    def matches(self, grams: np.ndarray, n_words: int, at: np.ndarray, similarity: float) -> Iterator[tuple[str, int, int, float, int]]:
        """Of one text's shingles: item, first word, words, similarity and bit distance of the best window of each item.

        at: positions of shingles that items of ``n_words`` words hold, each once.
        """
        size = self.sizes[n_words]
        width = min(len(size.grams[0]), len(grams))
        known = np.zeros(len(grams) + 1, dtype=np.int64)
        known[at + 1] = 1
        known = np.cumsum(known)
        needed = similarity * (width + len(size.grams[0])) / (1 + similarity) - 1e-9
        starts = np.flatnonzero(known[width:] - known[: len(grams) - width + 1] >= needed)
        best: dict[int, tuple[float, int, int]] = {}
        n_at_once = max(1, min(4096, CELLS // len(size.items)))
        for first in range(0, len(starts), n_at_once):
            some = starts[first : first + n_at_once]
            base, end = some[0], some[-1] + width
            total = np.zeros((end - base + 1, 64), dtype=np.int32)
            np.cumsum(_bits(grams[base:end]), axis=0, out=total[1:])
            prints = _packed(total[some + width - base] - total[some - base])
            near = np.zeros((len(some), len(size.items)), dtype=bool)
            for b, values in enumerate(prints[:, None].view(np.uint8).T):
                near |= size.blocks[b][values]
            window, item = np.nonzero(near)
            bits = np.bitwise_count(prints[window] ^ size.prints[item])
            inside = bits <= self.radius
            for w, i, d in zip(some[window[inside]].tolist(), item[inside].tolist(), bits[inside].tolist()):
                found = weighted_jaccard(grams[w : w + width], size.grams[i])
                if found >= similarity and (i not in best or found > best[i][0]):
                    best[i] = (found, w, d)
        for i, (found, w, d) in best.items():
            yield size.items[i], w, width + (n_words - len(size.grams[0])), found, d

    def scan(self, texts: list[bytes], similarity: float) -> Iterator[tuple[int, int, int, int, float, int]]:
        """Number of the text, then a match, for all texts of a piece."""
        data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        starts, ends = word_starts(data)
        words = word_hashes(data, starts, ends)
        own = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
        for n in self.lengths:
            if len(words) < n:
                continue
            grams = word_grams(words, n)
            at, n_words = self.hits(grams)
            fits = (own[at] == own[at + n - 1]) & (np.minimum(n_words, SHINGLE) == n)
            at, n_words = at[fits], n_words[fits]
            order = np.lexsort((at, n_words, own[at]))
            at, n_words = at[order], n_words[order]
            text = own[at]
            new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (n_words[1:] != n_words[:-1])])) if len(at) else []
            for k, first in enumerate(new):
                last = new[k + 1] if k + 1 < len(new) else len(at)
                t = int(text[first])
                begin, end = np.searchsorted(own, [t, t + 1])
                for match in self.matches(grams[begin : end - n + 1], int(n_words[first]), at[first:last] - begin, similarity):
                    yield t, *match


def _lowered(text: str) -> Column:
    """A text column in lower case, the same for items and documents; a final sigma, which depends on what follows, is a sigma."""
    return F.replace(F.lower(F.col(text).cast("string")), F.lit("ς"), F.lit("σ"))


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, lower-cased text and its digest of the items with a text."""
    items = benchmark.select(F.col("item_id").cast("long"), _lowered("text").alias("text")).filter("text is not null")
    return items.withColumn("item", F.md5("text"))


def _indexes(items: DataFrame, radius: int, block_bytes: int) -> Iterator[tuple[Index, bool]]:
    """The distinct texts in blocks of about ``block_bytes`` at most, and whether a block is the only one."""
    texts = items.groupBy("item").agg(F.first("text").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-total // block_bytes)
    for i in range(n):
        own = texts.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == i)
        yield Index([(r["item"], r.text.encode()) for r in own.orderBy("item").collect()], radius), n == 1


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, first_word, n_words, similarity, bits: the best window of each item in each text that has one.

    docs: doc_id, text. benchmark: item_id, text. Words are runs of letters and digits, lower-cased. Items without
    words match nothing; items and windows of fewer than five words are one shingle. A text shorter than an item
    is one window. Of equal windows the first counts. Null texts are empty, null ids stay null, repeated rows give
    a row each, empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item string, first_word long, n_words long, similarity double, bits int"
    base = docs.select(F.col("doc_id").cast("long"), _lowered("text").alias("text"))
    items = _items(benchmark)

    def found(index: Index, only: bool) -> DataFrame:
        sent = spark.sparkContext.broadcast(cloudpickle.dumps(index))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own_index = cloudpickle.loads(sent.value)
            for part, texts in pieces(batches, "text"):
                rows = list(own_index.scan(texts, similarity))
                if rows:
                    own, item, first, n, like, bits = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(own)), pa.array(item, pa.string()), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(like, pa.float64()), pa.array(bits, pa.int32())],
                        [x.split()[0] for x in schema.split(", ")],
                    )

        out = base.mapInArrow(run, schema)
        if only:
            return out
        out = stage(out, "leaks")  # so that a block's index can go before the next one comes
        sent.destroy()
        return out

    parts = [found(index, only) for index, only in _indexes(items, radius, block_bytes)]
    every = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    names = ["doc_id", "item_id", "first_word", "n_words", "similarity", "bits"]
    return every.join(items.select("item", "item_id"), "item").select(*names)


@spared
def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, whole, whose text has no window like an item of ``benchmark``."""
    spark, names, schema = docs.sparkSession, docs.columns, docs.schema

    def without(left: DataFrame, block: tuple[Index, bool]) -> DataFrame:
        index, only = block
        sent = spark.sparkContext.broadcast(cloudpickle.dumps(index))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own_index = cloudpickle.loads(sent.value)
            for batch in batches:
                keep, at = np.ones(batch.num_rows, dtype=bool), 0
                for part, texts in pieces(iter([batch]), "__low"):
                    for t, *_ in own_index.scan(texts, similarity):
                        keep[at + t] = False
                    at += part.num_rows
                yield batch.select(names).filter(pa.array(keep))

        out = left.withColumn("__low", _lowered("text")).mapInArrow(run, schema)
        if only:
            return out
        out = stage(out, "clean")  # so that a block's index can go before the next one comes
        sent.destroy()
        discard(left)
        return out

    return reduce(without, _indexes(_items(benchmark), radius, block_bytes), docs)
