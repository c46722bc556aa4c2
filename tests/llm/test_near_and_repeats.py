"""SimHash near-dedup and suffix dedup against brute force."""

import random

import brute
import numpy as np
import pytest
import xxhash
from conftest import SMALL
from pyspark.sql import functions as F

from duoscreen.llm import common, simhash, suffix

SCHEMA = "doc_id long, text string, fp long, n_chars int"


def odd_rows():
    rng = random.Random(3)
    words = ["Ab", "cé", "de\tf", "x", "Zz", "日本", "q", "12"]
    base = " ".join(rng.choice(words) for _ in range(400))
    texts = [None, "", "  \n", "one", "One two three", base, base, base.replace("Ab", "ab", 1), "y " * 5000, "y " * 4000 + base[:700], base[300:900] + base[200:800]]
    return [(i * 7, t, 5, 0) for i, t in enumerate(texts)]


def test_fingerprints_and_classes_match_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(10_000 + d, t) for d, t, *_ in odd_rows()]
    prints = {d: brute.simhash(t) for d, t in rows}
    want = brute.near_classes(prints)
    for group_rows in (1 << 16, 1):
        got = simhash.near_components(spark.createDataFrame(rows, "doc_id long, text string"), group_rows=group_rows).collect()
        assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{p:016x}", want[d]) for d, p in prints.items()}


def test_links_within_radius_are_found_in_any_bits(spark):
    rng = random.Random(1)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for p in list(prints):
        for n in (1, 3, 4, 5):
            prints.append(p ^ sum(1 << b for b in rng.sample(range(64), n)))
    chain = [rng.getrandbits(64)]
    for _ in range(40):
        chain.append(chain[-1] ^ sum(1 << b for b in rng.sample(range(64), 4)))
    prints += chain
    want = brute.near_classes(dict(enumerate(prints)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    for group_rows in (1 << 16, 3):
        links = simhash.near_links(spark.createDataFrame([(s,) for s in set(signed)], "fp long"), group_rows=group_rows)
        found = {r.node: r.component for r in common.components(links).collect()}
        groups = {}
        for i, s in enumerate(signed):
            groups.setdefault(found.get(s, s), set()).add(want[i])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_near_dedup_keeps_one_of_each_group(spark):
    rows = [*odd_rows(), (35, odd_rows()[5][1], 5, 0), (None, "alone here", 5, 0), (None, "alone here", 5, 0)]
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fp", "n_chars"]
    ids = [r.doc_id for r in kept.collect()]
    want = brute.near_classes({d: brute.simhash(t) for d, t, *_ in odd_rows()})
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values())) and ids.count(None) == 1


def test_near_dedup_keeps_a_row_of_each_group_whatever_the_ids(spark):
    rng = random.Random(8)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(300)) for _ in range(9)]
    near = [t + "\n" for t in texts]
    rows = [(5, t) for t in texts[:4]] + [(7 + i, t) for i, t in enumerate(near[:4])]
    rows += [(None, texts[0]), (None, near[4]), (None, texts[4]), (None, texts[4]), (None, texts[5]), (3, near[5]), (3, None), (None, "")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [3, 3, 5, 5, 5, 5]
    assert {r.text for r in got if r.doc_id == 5} == set(texts[:4]) and {r.text for r in got if r.doc_id == 3} == {near[5], None}
    assert [r.text in (texts[4], near[4]) for r in got if r.doc_id is None] == [True]


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.near_links(spark.createDataFrame([], "fp long"), radius=3)


@pytest.mark.parametrize("group_rows", [1 << 15, 2])
def test_repeats_match_brute_force(spark, monkeypatch, group_rows):
    monkeypatch.setattr(suffix, "GROUP_ROWS", group_rows)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(20_000 + d, t) for d, t, *_ in odd_rows()]
    got = suffix.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute.repeats(rows)


def test_repeats_in_cut_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE_BYTES", 150)
    got = suffix.report(spark.createDataFrame(odd_rows(), SCHEMA)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute.repeats([r[:2] for r in odd_rows()])


def test_repeated_rows_are_one_document(spark):
    rows = [*odd_rows(), odd_rows()[5]]
    got = [r for r in suffix.report(spark.createDataFrame(rows, SCHEMA)).collect() if r.doc_id == 35]
    assert len(got) == 2 and got[0] == got[1]


def test_stretches_are_hashed_by_the_other_polynomial(monkeypatch):
    tables = suffix._TABLES.copy()
    tables[0] = 0
    monkeypatch.setattr(suffix, "_TABLES", tables)
    found = [suffix.anchors(np.frombuffer(t * 50, np.uint8), np.full(100, 100)) for t in (b"ab", b"cd")]
    assert found[0][0] == found[1][0] and found[0][1] != found[1][1]


def test_texts_without_ids_stay_apart(spark):
    rng = random.Random(6)
    passage, one, two = ("".join(rng.choices("abcdefghij", k=n)) for n in (150, 300, 500))
    bits = {}
    for i in range(20000):
        text = f"({passage}){i:08d}{one}"
        bits[xxhash.xxh64_intdigest(text.encode(), 42) & 0xFFFFFF] = text
    pairs = ((bits.get(xxhash.xxh64_intdigest(t.encode(), 42) & 0xFFFFFF), t) for t in (f"{i:08d}{two}" for i in range(20000)))
    a, b = next((x, y) for x, y in pairs if x)
    for doc in (None, 8):
        rows = [(1, f"<{passage}>"), (doc, a), (doc, b)]
        got = suffix.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in got) == [(152, 0, 0), (len(a), 150, 1), (len(b), 0, 0)]


def test_texts_without_repeats(spark):
    kept = {r.doc_id: r for r in suffix.without_repeats(spark.createDataFrame(odd_rows(), SCHEMA)).collect()}
    whole = brute.repeats([r[:2] for r in odd_rows()])
    assert set(kept) == {d for d, (n, gone, _, _) in whole.items() if not n or gone < n}
    for d, r in kept.items():
        assert r.n_chars == len(r.text) and len(r.text.encode()) <= whole[d][0] - whole[d][1]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_components(empty).count() == 0 and suffix.report(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0 and suffix.without_repeats(empty).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in common.components(links).collect()} == {0}
