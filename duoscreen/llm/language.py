"""Language ID with bit-sliced Bloom filters of byte n-grams.

One table of ``slots`` words holds the Bloom filters of all languages side by side: bit l of a slot belongs to
language l. The AND of an n-gram's slots is the set of all languages that hold it. The bits are counted by
language over the whole text, corrected for the rate of false positives that each language's filling implies,
and the largest count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duoscreen.llm.common import PIECE_BYTES, mix64, shared

#: Label of a text without letters.
NONE = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)


@dataclass(frozen=True)
class Filters:
    """langs: bit order. table: slots x ceil(languages / 64) words. false: rate of false positives by language."""

    langs: list[str]
    table: np.ndarray
    false: np.ndarray
    gram: int
    hashes: int


def grams(text: bytes, n: int) -> np.ndarray:
    """Packed byte n-grams (up to 8 bytes) of lower-cased text between blanks; other ASCII counts as blank."""
    data = np.full(len(text) + 2 * (n // 2), 32, dtype=np.uint8)
    data[n // 2 : n // 2 + len(text)] = _FOLD[np.frombuffer(text, dtype=np.uint8)]
    out = np.zeros(max(0, len(data) - n + 1), dtype=np.uint64)
    letters = np.zeros(len(out), dtype=bool)
    for i in range(n):
        byte = data[i : i + len(out)]
        out |= byte.astype(np.uint64) << np.uint64(8 * i)
        letters |= byte != 32
    return out[letters]


def slots_of(g: np.ndarray, hashes: int, slots: int) -> Iterator[np.ndarray]:
    """The places of each n-gram in the table, one array for each hash function."""
    one = mix64(g + np.uint64(0x9E3779B97F4A7C15))
    two = mix64(one) | np.uint64(1)
    for i in range(hashes):
        yield ((one + np.uint64(i) * two) % np.uint64(slots)).astype(np.int64)


def _lowered(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for batch in batches:
        low = pc.utf8_lower(batch.column("text"))
        letter = pc.fill_null(pc.match_substring_regex(low, r"\p{L}"), False)
        texts = pc.if_else(letter, low, None).cast(pa.large_binary())
        yield batch.select(keep), texts


def sampled(rows: DataFrame, part: Column) -> DataFrame:
    """The rows of ``rows`` (id, text, lang) that a language's share in the map ``part`` lets in."""
    return rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < part[F.col("lang")] * (1 << 20))


def fit(labelled: DataFrame, sample: int = 1500, gram: int = 5, slots: int = 1 << 19, hashes: int = 3, share: float = 0.5) -> Filters:
    """Filters learned from ``labelled`` (doc_id, text, lang).

    sample: about so many rows of each language are used, chosen by a hash of id and text, so that rows that share an id or have
    none are drawn one by one (only copies of a row stay together). An n-gram enters the filter
    of a language if it occurs twice in its sample and its frequency there is at least ``share`` of its largest
    frequency in any language. The driver gets one row for each language and at most ``slots`` words.
    """
    rows = labelled.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string"), F.col("lang").cast("string"))
    rows = rows.filter("lang is not null and text is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    words = max(1, -(-len(langs) // 64))
    if not langs:
        return Filters([], np.zeros((slots, 1), dtype=np.uint64), np.zeros(0), gram, hashes)
    place = {lang: i for i, lang in enumerate(langs)}
    part = F.create_map(*[F.lit(x) for lang in langs for x in (lang, sample / sizes[lang])])
    chosen = sampled(rows, part)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _lowered(batches, ["lang"]):
            names = np.array([place[x] for x in batch.column("lang").to_pylist()])
            for lang in np.unique(names):
                own = [grams(texts[int(i)].as_py(), gram) for i in np.flatnonzero(names == lang) if texts[int(i)].is_valid]
                if own:
                    g, n = np.unique(np.concatenate(own), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(g), lang, dtype=np.int32)), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"]
                    )

    counts = chosen.mapInArrow(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(F.broadcast(totals), "lang").select("gram", "lang", "n", (F.col("n") / F.col("total")).alias("rate"))
    top = F.expr("filter(found, x -> x.n >= 2 and x.rate >= best * %r)" % share)
    held = (
        rates.groupBy("gram")
        .agg(F.max("rate").alias("best"), F.collect_list(F.struct("lang", "n", "rate")).alias("found"))
        .select("gram", F.explode(top).alias("x"))
        .select("gram", F.col("x.lang").alias("lang"))
    )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, lang = np.asarray(batch.column("gram")).view(np.uint64), np.asarray(batch.column("lang"))
            bit = (np.uint64(1) << (lang % 64).astype(np.uint64)).view(np.int64)
            for at in slots_of(g, hashes, slots):
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array((lang // 64).astype(np.int32)), pa.array(bit)], ["slot", "word", "bits"])

    table = np.zeros((slots, words), dtype=np.uint64)
    filled = held.mapInArrow(fill, "slot long, word int, bits long").groupBy("slot", "word").agg(F.bit_or("bits").alias("bits"))
    got = filled.toArrow()
    table[np.asarray(got.column("slot")), np.asarray(got.column("word"))] = np.asarray(got.column("bits")).view(np.uint64)
    full = np.array([((table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))])
    return Filters(langs, table, np.minimum(full**hashes, 0.999), gram, hashes)


#: Set bits of each byte value.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def judge(filters: Filters, text: bytes) -> tuple[int, float]:
    """Index of the language and its share of the corrected counts; any language at 0 if no n-gram is known."""
    counts, total = np.zeros(64 * filters.table.shape[1], dtype=np.int64), 0
    slots, half = len(filters.table), filters.gram - 1
    for at in range(0, len(text), PIECE_BYTES):
        g = grams(text[max(0, at - half) : at + PIECE_BYTES], filters.gram)
        total += len(g)
        mask = None
        for place in slots_of(g, filters.hashes, slots):
            found = filters.table[place]
            mask = found if mask is None else mask & found
        sliced = np.ascontiguousarray(mask).view(np.uint8).reshape(len(g), -1)
        for i in range((len(filters.langs) + 7) // 8):
            counts[8 * i : 8 * i + 8] += np.bincount(sliced[:, i], minlength=256) @ _BITS
    true = np.maximum(counts[: len(filters.langs)] - filters.false * total, 0) / (1 - filters.false)
    best = int(np.argmax(true))
    return best, float(true[best] / true.sum()) if true.sum() > 0 else 0.0


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """All columns of ``docs`` and lang_pred, score. A null text or one without letters is ``und`` with score 0."""
    sent = shared(docs.sparkSession, filters)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*names).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent()
        for batch, texts in _lowered(batches, names):
            found = [judge(own, x.as_py()) if own.langs and x.is_valid else None for x in texts]
            labels = pa.array([NONE if x is None else own.langs[x[0]] for x in found], pa.string())
            scores = pa.array([0.0 if x is None else x[1] for x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, labels, scores], [*names, "lang_pred", "score"])

    return docs.select(*names).mapInArrow(run, schema)


def held_out() -> Column:
    """Rows that training must not see."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, **params: float) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text, lang).

    Filters are learned from rows that aren't held out and have a language; without any, all texts are ``und``.
    A null id is not held out. Repeated rows are judged alone, other columns are ignored.
    """
    base = docs.select("doc_id", "text", "lang")
    found = predict(base.select("doc_id", "text"), fit(base.filter(~held_out()), **params))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
