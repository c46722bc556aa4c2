"""Language ID by held-out accuracy, decontamination against brute force."""

import random

import brute
import numpy as np
import pytest
from conftest import SMALL

from duoscreen.llm import decontam, language

MEDIUM = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_languages_of_odd_texts(spark):
    rows = [(i, "the house of the rising sun and the moon", "en", 1) for i in range(0, 40)]
    rows += [(i, "le soleil et la lune sont dans le ciel", "fr", 1) for i in range(40, 80)]
    odd = [None, "", "123 ... !!", "é", "THE HOUSE", "la lune " * 20000]
    rows += [(100 + i, t, None, 2) for i, t in enumerate(odd)] + [(None, "the sun", "en", 3)] * 2
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: r.lang_pred for r in got}
    assert [found[100 + i] for i in range(3)] == ["und"] * 3 and found[103] in ("en", "fr")
    assert found[104] == "en" and found[105] == "fr" and found[None] == "en"


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.identify(docs).collect()] == ["und"]
    assert language.identify(docs.limit(0)).count() == 0


def test_many_languages(spark):
    rng = random.Random(2)
    rows = []
    for lang in range(70):
        syllables = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(12)]
        rows += [(100 * lang + i, " ".join(rng.choice(syllables) for _ in range(60)), f"l{lang:02d}") for i in range(8)]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    known = {d: lang for d, _, lang in rows}
    held = [r for r in got if r.held_out]
    assert held and all(r.lang_pred == known[r.doc_id] for r in held)


@pytest.mark.parametrize("block_bytes", [decontam.BLOCK_BYTES, 2000])
def test_leaks_match_brute_force(spark, block_bytes):
    rng = random.Random(4)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()][:20]
    items += [(900, "two words"), (901, None), (902, "!!"), (903, items[0][1])]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if len(r.text) < 3000][:80]
    for i, (_, text) in enumerate(items[:20]):
        words = text.upper().split()
        words[-1] = "changed"
        docs.append((1000 + i, f"before {docs[i][1]}\n{' ; '.join(words)}. after"))
        cut = words[: int(len(words) * 0.95)]
        docs.append((2000 + i, " ".join(cut)))
    docs += [(3000, None), (3001, ""), (3002, "here are two words, two words"), (None, items[3][1]), (3003, (docs[0][1] + " ") * 40 + items[5][1])]
    rng.shuffle(docs)
    got = decontam.leaks(
        spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int"),
        spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string"), block_bytes=block_bytes,
    ).collect()
    found = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.first_word) for r in got}
    want = {(d, i): (round(s, 9), at) for d, t in docs for i, (s, at) in brute.best_windows(t, items).items()}
    assert found == want and len(got) == len(found)


def test_letters_whose_lower_case_is_longer_or_depends_on_place(spark):
    turkish = " ".join(f"İSTANBUL{i} İyi gün{i}" for i in range(8))
    greek = " ".join(f"ΛΟΓΟΣ ΟΔΟΣ{'ΑΒΓΔΕΖΗΘ'[i]} ΦΩΣ" for i in range(8))
    items = spark.createDataFrame([(1, turkish), (2, greek)], "item_id long, text string")
    rows = [(1, f"Before {turkish} after"), (2, f"{greek}.Α"), (3, greek.lower()), (4, "clean words of no item")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontam.leaks(docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.similarity, r.bits) for r in got) == [(1, 1, 1.0, 0), (2, 2, 1.0, 0), (3, 2, 1.0, 0)]
    assert [tuple(r) for r in decontam.clean(docs, items).collect()] == [rows[3]]


def test_clean_keeps_whole_rows(spark):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    text = items.first().text
    docs = spark.createDataFrame([(1, text, 5), (2, "clean", 6), (None, None, 7), (2, "clean", 6)], "doc_id long, text string, extra int")
    assert sorted(tuple(r) for r in decontam.clean(docs, items).fillna(-1, ["doc_id"]).collect() if r.doc_id >= 0) == [(2, "clean", 6)] * 2
    assert decontam.clean(docs, items).count() == 3 and decontam.clean(docs.limit(0), items).count() == 0
    assert decontam.clean(docs, items.limit(0)).count() == 4 and decontam.leaks(docs, items.limit(0)).count() == 0


def test_items_with_one_prompt_cost_nothing_where_only_the_prompt_is_found():
    import time

    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    prompt = words(8)
    items = [(str(i), f"{prompt} {words(12)}") for i in range(2000)]
    index = decontam.Index([(i, t.encode()) for i, t in items], decontam.RADIUS)
    text = " ".join(f"{prompt} {words(12)}" for _ in range(20)).encode()
    start = time.perf_counter()
    assert list(index.scan([text], 0.8)) == [] and time.perf_counter() - start < 0.1
    mixed = f"{words(30)} {items[7][1]} {prompt} {items[1500][1]} {prompt}"
    found = {m[1]: (m[2], m[4]) for m in index.scan([mixed.encode()], 0.8)}
    want = {i: (at, s) for i, (s, at) in brute.best_windows(mixed, [items[k] for k in range(0, 2000, 1) if k in (7, 1500) or k % 100 == 0]).items()}
    assert found == want and set(found) == {"7", "1500"}


def test_pairs_at_the_limit_lie_within_the_radius():
    rng = np.random.default_rng(1)
    for n in (9, 18, 36):
        m = int(np.ceil(2 * n * 0.8 / 1.8 - 1e-9))
        hashes = rng.integers(0, 1 << 64, size=(4000, 2 * n - m), dtype=np.uint64)
        bits = 2 * np.unpackbits(hashes.view(np.uint8), axis=1).reshape(4000, 2 * n - m, 64).astype(np.int16) - 1
        apart = ((bits[:, :n].sum(1) > 0) != (bits[:, n - m :].sum(1) > 0)).sum(1)
        assert apart.max() <= decontam.RADIUS


def test_clean_in_blocks_equals_clean_at_once(spark):
    items, docs = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("benchmark", "documents"))
    one, many = (sorted(r.doc_id for r in decontam.clean(docs, items, block_bytes=n).collect()) for n in (decontam.BLOCK_BYTES, 3000))
    assert one == many and len(one) < docs.count()
