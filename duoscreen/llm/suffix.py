"""Removal of repeated byte strings by a sparse suffix sort that compares prefix polynomial hashes.

A byte goes if a string of ``length`` bytes that covers it also starts earlier. Sorting every suffix of a corpus
would write many times the corpus. Instead each string of ``length`` bytes names one of its own positions, the
``gram`` with the smallest hash, so equal strings name the same place in themselves. The suffixes that start at
named positions, about two in seventy, are sorted with all they stand for: an anchor is a position with the run of
strings that name it, and one subtraction of prefix hashes gives the hash of the stretch that the run covers.

1. Map: anchors of each text; within a batch, all but the first of equal anchors are settled at once, so a passage
   that a third of the corpus holds leaves its task once a batch.
2. Sort by gram hash, stretch hash and place: all but the first of equal stretches are removed whole. Anchors with
   equal gram and different stretches may share a part of their strings only.
3. The bytes that those cover meet in a second sort by gram, where prefix hashes compare the single strings. A gram
   with very many of them sends on the hashes of its strings, which a third sort settles.

Two positions count as equal only if two hashes agree: gram and stretch, or two polynomials over different tables,
so a collision of one is verified by the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscreen.llm.common import PIECE_BYTES, mix64, pieces, spared, stage

LENGTH = 100
GRAM = 32

_BITS = np.uint64(22)
_LOW = np.uint64((1 << 22) - 1)
_RANDOM = np.random.default_rng(100)
_TABLES = _RANDOM.integers(0, 1 << 64, size=(2, 256), dtype=np.uint64)
_STEPS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

#: Marks a removed stretch among anchors; an anchor stands for fewer strings.
CUT = 255
#: Contexts that are read at a time, and of one gram that are compared at once; of more, the strings are sorted apart.
READ_ROWS = 1 << 12
GROUP_ROWS = 1 << 15
#: Stands for a null id: it sorts last.
NO_ID = (1 << 63) - 1

Rows = tuple[np.ndarray, ...]


class Powers:
    """Powers of an odd step and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, step: int):
        self.step, self.back = step, pow(step, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            def grown(step: int) -> np.ndarray:
                out = np.full(n, step, dtype=np.uint64)
                out[0] = 1
                return np.cumprod(out)

            self.up, self.down = grown(self.step), grown(self.back)
        return self.up, self.down


_POWERS = [Powers(s) for s in _STEPS]


def prefix_hashes(data: np.ndarray, which: int = 0) -> np.ndarray:
    """Running polynomial hash; the difference of two, times a power, is the hash of the bytes between."""
    up, _ = _POWERS[which].upto(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLES[which][data] * up[: len(data)], out=out[1:])
    return out


def between(prefix: np.ndarray, first: np.ndarray, last: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of the bytes from first to last (exclusive)."""
    _, down = _POWERS[which].upto(len(prefix))
    return mix64((prefix[last] - prefix[first]) * down[first])


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Rows:
    """Of texts laid end to end: gram hash, stretch hash, first string and strings beyond it of each anchor.

    ends: for each byte the end of its text.
    """
    n = len(data)
    if n < length:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    prefix = prefix_hashes(data)
    _, down = _POWERS[0].upto(n + 1)
    grams = mix64((prefix[gram:] - prefix[: n + 1 - gram]) * down[: n + 1 - gram])
    least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    width, reach = length - gram + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    starts = np.flatnonzero(ends[: n - length + 1] - np.arange(n - length + 1) >= length)
    if not len(starts):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    place = (least[starts] & _LOW).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    low, high = starts[new], starts[np.concatenate([new[1:], [len(starts)]]) - 1]
    # over the other polynomial, so that gram and stretch verify each other
    stretch = between(prefix_hashes(data, 1), low, high + length, 1)
    stretch = mix64(stretch ^ ((place[new] - low) << 8 | (high - low)).astype(np.uint64))
    return grams[place[new]], stretch, low, high - low


def packed(offset: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Offset and a number below 256 in one long that sorts by offset."""
    return offset.astype(np.int64) << 8 | n.astype(np.int64)


def later(keys: Rows, doc: np.ndarray, loc: np.ndarray, lead: tuple | None) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Of sorted rows: which begin a key, and which have the same key as an earlier row of another place.

    lead: keys and place of the first row of the key that the previous rows ended in; the new one comes back.
    """
    new = np.ones(len(doc), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    held = lead is not None and all(k[0] == x for k, x in zip(keys, lead[0]))
    if held:
        new[0] = False
    first = np.maximum.accumulate(np.where(new, np.arange(len(doc)), -1))
    own = first >= 0
    lead_doc = np.where(own, doc[first], lead[1] if held else 0)
    lead_loc = np.where(own, loc[first], lead[2] if held else 0)
    return new, (doc != lead_doc) | (loc != lead_loc), (tuple(k[-1] for k in keys), lead_doc[-1], lead_loc[-1])


def merged(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> Rows:
    """Stretches joined where they touch."""
    if not len(doc):
        return doc, first, last
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order], last[order]
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = doc[1:] != doc[:-1]
    text = np.cumsum(fresh)
    span = int(last.max()) + 1
    reach = np.maximum.accumulate(last + text * span) - text * span
    fresh[1:] |= first[1:] > reach[:-1]
    begin = np.flatnonzero(fresh)
    return doc[begin], first[begin], np.maximum.reduceat(last, begin)


def _settled(keys: Rows, doc: np.ndarray, loc: np.ndarray, n: np.ndarray, length: int) -> tuple[Rows, np.ndarray]:
    """Removed stretches of a batch, and the rows that are the first of their key in it."""
    order = np.lexsort((loc, doc, *reversed(keys)))
    keys, doc, loc, n = tuple(k[order] for k in keys), doc[order], loc[order], n[order]
    new, late, _ = later(keys, doc, loc, None)
    first = loc[late] >> 8
    return merged(doc[late], first, first + n[late] + length), order[new]


_ANCHORS = "g long, u long, doc long, loc long"


def _anchor_batch(g, u, doc, loc) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (g, u, doc, loc)], ["g", "u", "doc", "loc"])


def _cut_batch(cuts: Rows) -> pa.RecordBatch:
    doc, first, last = cuts
    return _anchor_batch(mix64((doc ^ first).view(np.uint64)), last - first, doc, packed(first, np.full(len(doc), CUT)))


def _laid_out(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of text parts (text, from, to) of about a piece; the parts of a long text overlap by a string less one."""
    group, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), PIECE_BYTES):
            end = min(len(text), at + PIECE_BYTES + length - 1)
            if size + end - at > 2 * PIECE_BYTES:
                yield group
                group, size = [], 0
            group.append((i, at, end))
            size += end - at
    if group:
        yield group


def _identified(docs: DataFrame) -> DataFrame:
    """``docs`` with what names a text: its id and the 128 bits of its digest."""
    return docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__digest": F.md5("text")})


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """__id, __digest and the removed stretches (__cuts) of each text of ``docs`` (doc_id, text) that has any."""
    source = _identified(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    source = source.select("__id", "__digest", "text")
    # each distinct text of an id gets a number of its own, in the order of ids
    names = source.select("__id", "__digest").distinct().orderBy("__id", "__digest")
    names = stage(names.withColumn("doc", F.monotonically_increasing_id()), "texts")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(batch: pa.RecordBatch) -> Iterator[Rows]:
            for part, texts in pieces(iter([batch]), "text"):
                ids = np.asarray(part.column("doc"))
                for group in _laid_out(texts, length):
                    data = np.frombuffer(b"".join(texts[i][a:b] for i, a, b in group), dtype=np.uint8)
                    which, begin, end = (np.array(x) for x in zip(*group))
                    sizes = end - begin
                    ends = np.cumsum(sizes)
                    g, u, low, n = anchors(data, np.repeat(ends, sizes), length, gram)
                    own = np.searchsorted(ends, low, side="right")
                    text = which[own]
                    offset = low - (ends - sizes)[own] + begin[own]
                    yield g, u, ids[text], packed(offset, n), n

        for batch in batches:
            found = [x for x in rows(batch) if len(x[0])]
            if found:
                g, u, doc, loc, n = (np.concatenate(x) for x in zip(*found))
                cuts, first = _settled((g, u), doc, loc, n, length)
                yield _anchor_batch(g[first], u[first], doc[first], loc[first])
                yield _cut_batch(cuts)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by gram, stretch and place: removed stretches, and anchors to unroll (u 0)."""
        lead, held, shown = None, None, False
        for batch in batches:
            g, u, doc, loc = (np.asarray(batch.column(c)) for c in ("g", "u", "doc", "loc"))
            cut = (loc & 0xFF) == CUT
            if cut.any():
                yield _anchor_batch(g[cut], u[cut], doc[cut], loc[cut])
                g, u, doc, loc = g[~cut], u[~cut], doc[~cut], loc[~cut]
            if not len(g):
                continue
            new, late, lead = later((g, u), doc, loc, lead)
            first = loc[late] >> 8
            yield _cut_batch(merged(doc[late], first, first + (loc[late] & 0xFF) + length))
            g, doc, loc = g[new], doc[new], loc[new]
            if held is not None:
                g, doc, loc = (np.concatenate([[x], y]) for x, y in zip(held, (g, doc, loc)))
            if not len(g):
                continue
            begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            sizes = np.diff(np.concatenate([begin, [len(g)]]))
            many = np.repeat(sizes > 1, sizes)
            if shown:
                many[: sizes[0]] = True
            emit = many.copy()
            if held is not None and shown:
                emit[0] = False
            yield _anchor_batch(g[emit], np.zeros(emit.sum(), np.int64), doc[emit], loc[emit])
            held, shown = (g[-1], doc[-1], loc[-1]), bool(many[-1])

    texts = source.join(names, ["__id", "__digest"]).select("doc", "text")
    found = texts.mapInArrow(find, _ANCHORS).repartition("g").sortWithinPartitions("g", "u", "doc", "loc").mapInArrow(settle, _ANCHORS)
    found = stage(found, "anchors")
    place = {"offset": F.expr("shiftright(loc, 8)"), "n": F.expr("loc & 255")}
    cuts = found.withColumns(place).filter(f"n = {CUT}").select("doc", F.col("offset").alias("first"), (F.col("offset") + F.col("u")).alias("last"))
    lists = (
        found.withColumns(place).filter(f"n != {CUT}").groupBy("doc").agg(F.collect_list(F.struct("g", "offset", "n")).alias("runs"))
    )

    def unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes that each anchor's strings cover."""
        for batch in batches:
            for part, texts in pieces(iter([batch]), "text"):
                runs = part.column("runs")
                text = np.repeat(np.arange(len(texts)), np.asarray(pa.compute.list_value_length(runs), dtype=np.int64))
                flat = runs.flatten()
                g, offset, n = (np.asarray(flat.field(i)).astype(np.int64) for i in range(3))
                context = [texts[t][o : o + s] for t, o, s in zip(text.tolist(), offset.tolist(), (n + length).tolist())]
                ids = np.asarray(part.column("doc"))
                columns = [pa.array(g), pa.array(ids[text]), pa.array(packed(offset, n)), pa.array(context, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["g", "doc", "loc", "context"])

    def strings(g: np.ndarray, doc: np.ndarray, loc: np.ndarray, context: list[bytes]) -> tuple[Rows, Rows]:
        """Removed stretches among the strings of some anchors, and two hashes and the place of each other string."""
        n = loc & 0xFF
        data = np.frombuffer(b"".join(context), dtype=np.uint8)
        run = np.repeat(np.arange(len(n)), n + 1)
        step = np.arange(len(run)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
        start = (np.cumsum(n + length) - (n + length))[run] + step
        one, two = (between(prefix_hashes(data, w), start, start + length, w) for w in (0, 1))
        own, place = doc[run], packed((loc >> 8)[run] + step, np.zeros(len(run), np.int64))
        cuts, first = _settled((g[run].view(np.uint64), one, two), own, place, np.zeros(len(run), np.int64), length)
        return cuts, (one[first], two[first], own[first], place[first])

    def settle_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of contexts sorted by gram: removed stretches; of a gram with very many, the strings themselves."""

        def done(rows: tuple, whole: bool) -> Iterator[pa.RecordBatch]:
            cuts, rest = strings(*rows)
            yield _cut_batch(cuts)
            if not whole:
                yield _anchor_batch(*rest)

        held, large = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, READ_ROWS):
                part = batch.slice(at, READ_ROWS)
                rows = (*(np.asarray(part.column(c)) for c in ("g", "doc", "loc")), part.column("context").to_pylist())
                if large is not None:
                    same = int(np.searchsorted(rows[0], large, side="right"))
                    if same:
                        yield from done(tuple(x[:same] for x in rows), False)
                    if same == part.num_rows:
                        continue
                    rows, large = tuple(x[same:] for x in rows), None
                if held is not None:
                    rows = (*(np.concatenate(x) for x in zip(held[:3], rows[:3])), held[3] + rows[3])
                edge = int(np.searchsorted(rows[0], rows[0][-1], side="left"))
                if edge:
                    yield from done(tuple(x[:edge] for x in rows), True)
                held = tuple(x[edge:] for x in rows)
                if len(held[0]) > GROUP_ROWS:
                    yield from done(held, False)
                    held, large = None, held[0][-1]
        if held is not None:
            yield from done(held, True)

    def settle_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None
        for batch in batches:
            g, u, doc, loc = (np.asarray(batch.column(c)) for c in ("g", "u", "doc", "loc"))
            cut = (loc & 0xFF) == CUT
            first, last = loc[cut] >> 8, (loc[cut] >> 8) + u[cut]
            doc_cut = doc[cut]
            g, u, doc, loc = g[~cut], u[~cut], doc[~cut], loc[~cut]
            if len(g):
                _, late, lead = later((g, u), doc, loc, lead)
                at = loc[late] >> 8
                doc_cut = np.concatenate([doc_cut, doc[late]])
                first, last = np.concatenate([first, at]), np.concatenate([last, at + length])
            doc_cut, first, last = merged(doc_cut, first, last)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (doc_cut, first, last)], ["doc", "first", "last"])

    named = lists.join(names, "doc").join(source, ["__id", "__digest"]).dropDuplicates(["__id", "__digest"])
    contexts = named.select("doc", "text", "runs").mapInArrow(unroll, "g long, doc long, loc long, context binary")
    groups = stage(contexts.repartition("g").sortWithinPartitions("g").mapInArrow(settle_groups, _ANCHORS), "strings").withColumns(place)
    parts = groups.filter(f"n = {CUT}").select("doc", F.col("offset").alias("first"), (F.col("offset") + F.col("u")).alias("last"))
    single = (
        groups.filter(f"n != {CUT}")
        .select("g", "u", "doc", "loc")
        .repartition("g")
        .sortWithinPartitions("g", "u", "doc", "loc")
        .mapInArrow(settle_strings, "doc long, first long, last long")
    )
    every = cuts.unionByName(parts).unionByName(single).groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("__cuts"))
    return every.join(names, "doc").select("__id", "__digest", "__cuts")


def _with_cuts(docs: DataFrame, **params: int) -> DataFrame:
    filled = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    return _identified(filled).join(removed(docs, **params), ["__id", "__digest"], "left")


def _spans(cuts: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, last in sorted((c["first"], c["last"]) for c in cuts or []):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [tuple(x) for x in out]


def _rest(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for first, last in spans:
        kept.append(text[at:first])
        at = last
    return b"".join([*kept, text[at:]])


def report(docs: DataFrame, **params: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs`` (doc_id, text).

    Strings of ``length`` bytes (100) are removed where they also start earlier: in a smaller id or earlier in the
    same text. A null text is empty. Null ids come last. Rows that repeat id and text are one document and get its
    result each; different texts with an equal id, or with none, come in the order of their digests (128 bits).
    Other columns are ignored.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text"):
            spans = [_spans(c) for c in part.column("__cuts").to_pylist()]
            kept = [hashlib.sha256(_rest(t, s)).hexdigest() for t, s in zip(texts, spans)]
            numbers = [[len(t) for t in texts], [sum(b - a for a, b in s) for s in spans], [len(s) for s in spans]]
            arrays = [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in numbers), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in schema.split(", ")])

    base = docs.select(F.col("doc_id").cast("long"), "text")
    return _with_cuts(base, **params).select("doc_id", "text", "__cuts").mapInArrow(run, schema)


@spared
def without_repeats(docs: DataFrame, **params: int) -> DataFrame:
    """All columns of ``docs`` with the repeated strings taken out of ``text`` and ``n_chars`` counted anew.

    Bytes of a character of which a part is removed go with it. Rows of which nothing but blanks is left after a
    removal are repeats as a whole and go.
    """
    names, schema = docs.columns, docs.withColumn("__whole", F.lit(True)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text"):
            spans = [_spans(c) for c in part.column("__cuts").to_pylist()]
            kept = [_rest(t, s).decode("utf-8", "ignore") if s else t.decode("utf-8", "ignore") for t, s in zip(texts, spans)]
            columns = [pa.array(kept, pa.string()) if c == "text" else part.column(c) for c in names]
            whole = pa.array([not s or not k.strip() == "" for k, s in zip(kept, spans)])
            yield pa.RecordBatch.from_arrays([*columns, whole], [*names, "__whole"])

    out = _with_cuts(docs, **params).select(*names, "__cuts").mapInArrow(run, schema).filter("__whole").drop("__whole")
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
