"""Ranked lexical search by the Best Position Algorithm over impact lists.

One scan counts, for each document, its terms and the occurrences of the items' terms. Each task then turns its own
documents, some at a time, into a list for each term, by falling impact, and answers every item on them: all lists are
read in parallel; a document seen for the first time is looked up in every list, which gives its whole score and
marks its positions. A list's best position is the end of its unbroken run of seen positions. An unseen document lies
beyond it in every list, so the impacts behind the best positions sum to a bound on its score, and reading stops once
that bound is strictly below the kth score (equal scores are ranked by id, so a tie may still enter).

A document is in one list set only, so the best k of all tasks' best k are the best k. Only those rows are shuffled.
Items come in blocks of bounded text; each block costs one scan.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duoscreen.llm.common import pieces, shared, stage
from duoscreen.session import discard

#: Documents returned for an item.
DEPTH = 50
#: Bytes of distinct item terms that are sent to the tasks at once; an item is never split.
BLOCK_BYTES = 1 << 24
#: Documents and postings that a task indexes at a time.
CHUNK_ROWS = 1 << 15
CHUNK_POSTINGS = 1 << 21
#: Positions that a first round reads of each list; later rounds read twice as many, up to the second number.
FIRST_READ, MOST_READ = 32, 1 << 13
#: Tasks' results of an item that are merged at once in a first step.
FAN_IN = 64

_LETTERS = bytes(range(65, 91))
_GAPS = bytes(b for b in range(128) if not chr(b).isalnum())
_TABLE = bytes.maketrans(_LETTERS + _GAPS, _LETTERS.lower() + b" " * len(_GAPS))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of other characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_TABLE).split()


def term_array(text: Column) -> Column:
    """The same as ``terms_of``, as an expression."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), _LETTERS.decode(), _LETTERS.lower().decode())
    return F.regexp_extract_all(lowered, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))


@dataclass
class Items:
    """A block of the items: each one's digest and terms, as numbers of the block's vocabulary."""

    digests: list[str]
    terms: list[list[int]]
    vocabulary: dict[bytes, int]
    k: int
    #: Of all documents: number, terms, and by term the weight; known after the first scan.
    n_docs: int = 0
    n_terms: int = 0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


class Lists:
    """Impact lists of some documents: by term and document, and the order of each list by falling impact."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_terms: int):
        order = np.lexsort((docs, terms))
        self.docs, self.impacts = docs[order], impacts[order]
        self.bounds = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.by_impact = np.lexsort((self.docs, -self.impacts, terms[order]))
        self.position = np.empty(len(order), dtype=np.int64)
        self.position[self.by_impact] = np.arange(len(order))


def best_positions(lists: Lists, terms: list[int], n_docs: int, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores that hold the k best of the lists' documents, as far as these can beat the ``known`` scores."""
    spans = [(lists.bounds[t], lists.bounds[t + 1]) for t in terms]
    spans = [(low, high) for low, high in spans if high > low and lists.impacts[lists.by_impact[low]] > 0]
    seen = np.zeros(n_docs, dtype=bool)
    marks = [np.zeros(high - low, dtype=bool) for low, high in spans]
    best = [0] * len(spans)
    kept = np.sort(known)[::-1][:k]
    found: list[np.ndarray] = []
    scores: list[np.ndarray] = []
    depth, step = 0, FIRST_READ
    while spans:
        read = np.concatenate([lists.docs[lists.by_impact[low + depth : min(high, low + depth + step)]] for low, high in spans])
        new = np.unique(read[~seen[read]])
        if len(new):
            seen[new] = True
            total = np.zeros(len(new), dtype=np.int64)
            for (low, high), mark in zip(spans, marks):
                at = low + np.searchsorted(lists.docs[low:high], new)
                holds = at < high
                holds[holds] = lists.docs[at[holds]] == new[holds]
                at = at[holds]
                total[holds] += lists.impacts[at]
                mark[lists.position[at] - low] = True
            found.append(new)
            scores.append(total)
            kept = np.concatenate([kept, total])
            kept = np.partition(kept, len(kept) - k)[-k:] if len(kept) > k else kept
        depth, step = depth + step, min(2 * step, MOST_READ)
        bound = 0
        for i, ((low, high), mark) in enumerate(zip(spans, marks)):
            if best[i] < len(mark) and mark[best[i]]:
                ahead = int(np.argmin(mark[best[i] :]))
                best[i] = best[i] + ahead if ahead else len(mark)
            if best[i] < len(mark):
                bound += int(lists.impacts[lists.by_impact[low + best[i]]])
        if not bound or (len(kept) >= k and bound < kept.min()):
            break
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(scores)


def _counted(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, n (terms), terms and tf (numbers of the block's terms and their occurrences) of documents with a term."""
    schema = "doc_id long, n long, terms array<int>, tf array<int>"
    sent = shared(docs.sparkSession, items.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent().get
        for part, texts in pieces(batches, "text"):
            sizes, counts = [], []
            for text in texts:
                found = terms_of(text)
                count = Counter(map(number, found))
                count.pop(None, None)
                sizes.append(len(found))
                counts.append(count)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in counts])]), pa.int32())
            flat = [pa.ListArray.from_arrays(offsets, pa.array([x for c in counts for x in side(c)], pa.int32())) for side in (dict.keys, dict.values)]
            out = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), *flat], ["doc_id", "n", "terms", "tf"])
            yield out.filter(pa.array([n > 0 for n in sizes], pa.bool_()))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


class _Best:
    """The k best documents of each item so far: scores, ids and which ids are null."""

    def __init__(self, items: Items):
        self.items = items
        self.rows = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in items.terms]

    def add(self, chunk: list[pa.RecordBatch]) -> None:
        """Answers all items on the documents of a chunk."""
        items, table = self.items, pa.Table.from_batches(chunk).combine_chunks()
        n = table.column("n").to_pylist()
        ids = table.column("doc_id").fill_null(0).to_numpy()
        null = table.column("doc_id").is_null().to_numpy()
        length = np.array([50 + (50 * x * items.n_docs) // items.n_terms for x in n], dtype=np.int64)
        sizes = table.column("terms").combine_chunks().value_lengths().to_numpy()
        flat, tf = (table.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("terms", "tf"))
        own = np.repeat(np.arange(len(n)), sizes)
        impacts = items.weights[flat] * ((1_000_000_000 * tf) // (1000 * tf + 20 * length[own]))
        lists = Lists(flat, own, impacts, len(items.vocabulary))
        for i, terms in enumerate(items.terms):
            scores, old, gone = self.rows[i]
            at, new = best_positions(lists, terms, len(n), items.k, scores)
            at, new = at[new > 0], new[new > 0]
            scores, old, gone = np.concatenate([scores, new]), np.concatenate([old, ids[at]]), np.concatenate([gone, null[at]])
            first = np.lexsort((old, gone, -scores))[: items.k]
            self.rows[i] = scores[first], old[first], gone[first]

    def batch(self) -> pa.RecordBatch:
        sizes = [len(s) for s, _, _ in self.rows]
        digests = [d for d, n in zip(self.items.digests, sizes) for _ in range(n)]
        scores, ids, null = (np.concatenate(x) if x else np.zeros(0) for x in zip(*self.rows))
        return pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(ids, pa.int64(), mask=null), pa.array(scores, pa.int64())], ["digest", "doc_id", "score"])


def _found(counted: DataFrame, items: Items) -> DataFrame:
    """digest, doc_id and score of the best documents of each task."""
    sent = shared(counted.sparkSession, items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, chunk, rows, postings = _Best(sent()), [], 0, 0
        for batch in batches:
            if batch.num_rows:
                chunk.append(batch)
                rows, postings = rows + batch.num_rows, postings + len(batch.column("terms").flatten())
            if rows >= CHUNK_ROWS or postings >= CHUNK_POSTINGS:
                best.add(chunk)
                chunk, rows, postings = [], 0, 0
        if chunk:
            best.add(chunk)
        yield best.batch()

    return counted.mapInArrow(run, "digest string, doc_id long, score long")


def _answer(docs: DataFrame, own: list, k: int) -> DataFrame:
    """digest, doc_id and score for one block of distinct items, written."""
    words = sorted({t for r in own for t in r.terms})
    number = {t: i for i, t in enumerate(words)}
    items = Items([r.digest for r in own], [[number[t] for t in r.terms] for r in own], {t.encode(): i for t, i in number.items()}, k)
    counted = stage(_counted(docs, items), "term_counts")
    items.n_docs, items.n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = np.zeros(len(words), dtype=np.int64)
    for t, n in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        frequency[t] = n
    items.weights = np.array([math.floor(1000 * math.log((2 * items.n_docs + 2) / (2 * int(f) + 1))) for f in frequency], dtype=np.int64)
    found = stage(_found(counted, items), "lexical_hits")
    discard(counted)
    return found


def search(docs: DataFrame, items: DataFrame, k: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item.

    docs: doc_id, text. items: item_id, text. Null texts have no terms; items without terms have no rows, as have documents
    with score 0. Equal scores are ranked by id, null ids last. Each row of ``docs`` is a document, repeated
    or not; rows of ``items`` with equal id and set of terms are one item, and items of equal terms are searched once.
    An item_id with several different texts gets a ranking for each. Empty tables give an empty result; other columns are
    ignored.
    """
    spark = docs.sparkSession
    terms = items.select(F.col("item_id").cast("long"), F.array_sort(F.array_distinct(term_array(F.col("text")))).alias("terms")).filter("size(terms) > 0")
    queries = terms.withColumn("digest", F.sha2(F.array_join("terms", " "), 256)).select("item_id", "digest", "terms")
    sets = queries.groupBy("digest").agg(F.first("terms").alias("terms"))
    total = sets.agg(F.sum(F.length(F.array_join("terms", " ")) + 64)).first()[0] or 0
    n = -(-total // block_bytes)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]

    def first_of(rows: DataFrame, *by: str) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)

    parts = []
    for i in range(n):
        own = sets.filter(F.pmod(F.xxhash64("digest"), F.lit(n)) == i).orderBy("digest").collect()
        if own:
            parts.append(_answer(docs, own, k))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    hits = reduce(DataFrame.unionByName, parts).withColumn("part", F.floor(F.spark_partition_id() / FAN_IN))
    best = first_of(first_of(hits, "digest", "part").drop("rank", "part"), "digest")
    return queries.select("item_id", "digest").distinct().join(best, "digest").select("item_id", "rank", "doc_id", "score")
