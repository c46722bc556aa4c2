"""SimHash near-dedup with pivot distance tables.

Fingerprints of word shingles link at a small Hamming distance. Equal fingerprints are one node. Nodes meet in
groups that agree on some of ``parts`` bit blocks: a pair within ``radius`` bits leaves at least
``parts - radius`` blocks untouched, so it shares a group for some choice of that many blocks. Distances to random
reference fingerprints are all near 32, so they can't deal out the rows by themselves; inside a group they do what
the method asks: each member gets its row of distances to the pivots, a pair whose rows differ by more than the
radius in any coordinate is discarded (triangle inequality), and the survivors are verified bit by bit. A group
yields a spanning set of links, never all pairs. Groups above ``group_rows`` members take an exact linear way:
every member emits all fingerprints within half the radius in the bits that the group leaves free, and two members
link exactly if they emit a common one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscreen.llm.common import components, pieces, spared, stage

_ONE = np.uint64(1)
#: Stands for a null id: it sorts last.
NO_ID = (1 << 63) - 1


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the shingles of lower-cased ASCII-blank separated words; zero without words."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    n = min(words, len(tokens))
    begin, end = (ends - lengths)[: len(tokens) - n + 1].tolist(), ends[n - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(begin, end)), dtype=np.uint64, count=len(begin))
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4, keys: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fingerprint (as a signed long) and the long columns ``keys`` of every row of ``docs`` (doc_id, text)."""
    names = ["doc_id", "fp", *keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text"):
            prints = np.fromiter((fingerprint(t, words) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints.view(np.int64)), *(part.column(k) for k in keys)], names)

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *keys)
    return own.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def block_masks(parts: int, keep: int) -> list[int]:
    """Masks of all choices of ``keep`` among ``parts`` nearly equal bit blocks."""
    cuts = [64 * i // parts for i in range(parts + 1)]
    blocks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(parts)]
    return [sum(c) for c in combinations(blocks, keep)]


def pivot_table(prints: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint (rows) to each reference fingerprint (columns)."""
    return np.bitwise_count(prints[:, None] ^ pivots[None, :]).astype(np.int8)


def group_links(prints: np.ndarray, table: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that span the same components as all pairs within the radius."""
    left, right = [], []
    open_rows = np.arange(len(prints))
    queue: list[int] = []
    while len(open_rows):
        if not queue:
            queue, open_rows = [int(open_rows[0])], open_rows[1:]
        x = queue.pop()
        near = open_rows
        for c in range(table.shape[1]):
            near = near[np.abs(table[near, c] - table[x, c]) <= radius]
            if not len(near):
                break
        near = near[np.bitwise_count(prints[near] ^ prints[x]) <= radius]
        if len(near):
            left.append(np.full(len(near), prints[x]))
            right.append(prints[near])
            queue.extend(near.tolist())
            open_rows = np.setdiff1d(open_rows, near, assume_unique=True)
    return left, right


def near_links(prints: DataFrame, radius: int = 4, parts: int = 7, n_pivots: int = 16, group_rows: int = 1 << 16) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (column ``fp``) whose components are those of all links.

    radius: an even number, so that half of it works for large groups.
    """
    if radius % 2 or not 0 < radius < parts:
        raise ValueError("radius must be even and below the number of parts")
    masks = np.array(block_masks(parts, parts - radius), dtype=np.uint64)
    pivots = np.random.default_rng(64).integers(0, 1 << 64, size=n_pivots, dtype=np.uint64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column("fp")).view(np.uint64)
            for i, mask in enumerate(masks):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(fp), i, dtype=np.int16)), pa.array((fp & mask).view(np.int64)), pa.array(fp.view(np.int64))],
                    ["choice", "key", "fp"],
                )

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group. choice is -1 in a link, else that of a row of a large group."""

        def out(a, b, choice):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(a).view(np.int64)), pa.array(np.ascontiguousarray(b).view(np.int64)), pa.array(np.full(len(a), choice, dtype=np.int16))],
                ["a", "b", "choice"],
            )

        held_c, held_k, held_f = np.zeros(0, np.int16), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        large = None

        def finish(c, k, f):
            new = np.flatnonzero((np.diff(c) != 0) | (np.diff(k) != 0)) + 1
            starts = np.concatenate([[0], new])
            sizes = np.diff(np.concatenate([starts, [len(f)]]))
            two = starts[sizes == 2]
            if len(two):
                x, y = pivot_table(f[two], pivots), pivot_table(f[two + 1], pivots)
                two = two[(np.abs(x - y) <= radius).all(axis=1)]
                two = two[np.bitwise_count(f[two] ^ f[two + 1]) <= radius]
                if len(two):
                    yield out(f[two], f[two + 1], -1)
            left, right = [], []
            for at, n in zip(starts[sizes > 2], sizes[sizes > 2]):
                own = f[at : at + n]
                a, b = group_links(own, pivot_table(own, pivots), radius)
                left += a
                right += b
            if left:
                yield out(np.concatenate(left), np.concatenate(right), -1)

        for batch in batches:
            c, k, f = (np.asarray(batch.column(x)) for x in ("choice", "key", "fp"))
            f = f.view(np.uint64)
            if large is not None:
                same = (c == large[0]) & (k == large[1])
                if same.any():
                    yield out(f[same], f[same], large[0])
                c, k, f = c[~same], k[~same], f[~same]
                if not len(f):
                    continue
                large = None
            c, k, f = np.concatenate([held_c, c]), np.concatenate([held_k, k]), np.concatenate([held_f, f])
            last = np.flatnonzero((c == c[-1]) & (k == k[-1]))[0]
            if last:
                yield from finish(c[:last], k[:last], f[:last])
            held_c, held_k, held_f = c[last:], k[last:], f[last:]
            if len(held_f) > group_rows:
                large = (held_c[0], held_k[0])
                yield out(held_f, held_f, large[0])
                held_c, held_k, held_f = held_c[:0], held_k[:0], held_f[:0]
        if len(held_f):
            yield from finish(held_c, held_k, held_f)

    def ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All fingerprints within half the radius in the free bits."""
        for batch in batches:
            for choice, x in zip(np.asarray(batch.column("choice")), np.asarray(batch.column("a")).view(np.uint64)):
                free = [_ONE << np.uint64(i) for i in range(64) if not int(masks[choice]) >> i & 1]
                flips = [np.uint64(0)]
                for n in range(1, radius // 2 + 1):
                    flips += [np.bitwise_or.reduce(p) for p in combinations(free, n)]
                z = np.array(flips, dtype=np.uint64) ^ x
                yield pa.RecordBatch.from_arrays([pa.array(z.view(np.int64)), pa.array(np.full(len(z), x).view(np.int64))], ["z", "fp"])

    dealt = prints.select("fp").mapInArrow(deal, "choice short, key long, fp long")
    found = dealt.repartition("choice", "key").sortWithinPartitions("choice", "key").mapInArrow(links, "a long, b long, choice short")
    found = stage(found, "near_links")
    crowded = found.filter("choice >= 0").select("a", "choice")
    near = crowded.mapInArrow(ball, "z long, fp long")
    first = near.groupBy("z").agg(F.min("fp").alias("a"))
    rest = near.join(first, "z").filter("a != fp").select("a", F.col("fp").alias("b"))
    return found.filter("choice < 0").select("a", "b").unionByName(rest)


def _classes(prints: DataFrame, radius: int, **index: int) -> DataFrame:
    """fp, component (a fingerprint of it) and component_id (its smallest doc_id) of each fingerprint of ``prints``."""
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    groups = components(near_links(nodes, radius, **index)).withColumnRenamed("node", "fp")
    named = nodes.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return stage(named.join(least, "component").select("fp", "component", "component_id"), "classes")


def near_components(docs: DataFrame, words: int = 4, radius: int = 4, **index: int) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of ``docs`` (doc_id, text).

    A null text counts as empty; texts without words have fingerprint zero and link like any others. Rows that
    repeat an id are judged by their own text. A null id stays null and never names a component unless no
    member has an id. An empty table gives an empty result; other columns are ignored.
    """
    prints = stage(fingerprints(docs, words), "prints")
    return prints.join(_classes(prints, radius, **index), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@spared
def keep_one(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """One row of each component, the first by doc_id (nulls last) and two hashes of the text, with all columns of ``docs``.

    Rows are judged by their own text, also those that share an id and those without one. Of rows with equal id and
    text, which are one document, one stays.
    """
    keys = ("__id", "__one", "__two")
    own = docs.withColumns(
        {
            "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)),
            "__one": F.xxhash64("text"),
            "__two": F.xxhash64(F.lit(1), "text"),
        }
    )
    prints = stage(fingerprints(own, words, keys), "prints")
    rows = prints.join(_classes(prints, radius).select("fp", "component"), "fp")
    first = rows.groupBy("component").agg(F.min(F.struct(*keys)).alias("first")).select("first.*")
    return own.dropDuplicates(list(keys)).join(first, list(keys), "left_semi").select(*docs.columns)
