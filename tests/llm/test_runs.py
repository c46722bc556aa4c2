"""Periodic runs against a plain search of all lags, the SQL twin, and odd rows."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
from conftest import SMALL
from pyspark.sql import functions as F

from duoscreen.llm import catalog, runs


def plain(words):
    """All runs by trying every lag; the smallest period of a stretch by trying every period."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s = words[i : j + q]
            if j > i and len(s) >= max(6, 4 * q) and next(p for p in range(1, q + 1) if s[p:] == s[:-p]) == q:
                out.append((i, len(s), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def made_up(rng):
    n, k = rng.randrange(0, 70), rng.choice([1, 2, 2, 3, 5])
    w = [rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = rng.randrange(1, 2 + (n - a) // 3)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)] + [rng.randrange(k) for _ in range(rng.randrange(4))]
    return w + w[: rng.randrange(20)]


def test_runs_equal_all_lags():
    rng = random.Random(1)
    for _ in range(3000):
        w = made_up(rng)
        want = plain(w)
        assert runs.runs(np.array(w, dtype=np.int64)) == want, w
        assert not want or len(runs.may_repeat(np.array(w), np.zeros(len(w), np.int64))) == 1


def test_long_texts_of_one_word_and_of_long_periods():
    assert runs.runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    assert runs.runs(np.arange(200_000) % 999) == [(0, 200_000, 999)]
    assert runs.runs(np.concatenate([np.arange(50_000), np.arange(50_000), np.arange(50_000)])) == []
    assert runs.runs(np.tile(np.arange(50_000), 4)) == [(0, 200_000, 50_000)]


ODD = ["a a a a a", "a a a a a a", "a b a b a b a b", "x a b a b a b a b y", "a b c a b c a b c a b", " a  a\ta\na a a ", "é é é é é é é", "A a A a A a A a", None, "", "a\x85a a a a a a a"]


def test_collapsed_text_and_odd_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "b b b b b b b", "x"), (1, "a a a a a a", "x")]
    got = runs.find(spark.createDataFrame(rows, "doc_id long, text string, runs string")).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_words): r for r in got}
    assert by[0, 5].runs == [] and by[0, 5].best is None and by[0, 5].collapsed == "a a a a a"
    assert by[1, 6].collapsed == "a" and [tuple(x) for x in by[1, 6].runs] == [(0, 6, 1)]
    assert by[2, 8].collapsed == "a b" and by[3, 10].collapsed == "x a b y" and tuple(by[3, 10].best) == (1, 8, 2)
    assert by[4, 11].runs == [] and by[5, 6].collapsed == "a" and by[6, 7].collapsed == "é" and by[7, 8].collapsed == "A a"
    assert by[8, 0].collapsed == "" and by[9, 0].n_words == 0 and by[None, 7].collapsed == "b"
    assert runs.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ties_of_the_best_run(spark):
    text = "q a a a a a a r b b b b b b s c d c d c d c d c d c d"
    best = runs.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().best
    assert tuple(best) == (1, 6, 1)


def test_query_equals_plain_search(spark):
    docs = {r.doc_id: r.text.split() for r in catalog.with_planted_runs(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    got = {r.doc_id: r for r in catalog.op13(spark, SMALL).collect()}
    assert set(got) == set(docs) and sum(r.n_runs > 0 for r in got.values()) >= 5
    for doc, words in docs.items():
        r = got[doc]
        if len(words) > 900:
            continue  # the plain search takes long
        found = plain(words)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if found else None
        assert (r.n_words, r.n_runs) == (len(words), len(found))
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()


def test_twin_on_odd_rows(spark, tmp_path):
    rng = random.Random(8)
    texts = [*ODD, *[" ".join("abcde"[x] for x in made_up(rng)) for _ in range(150)]]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = catalog.op13(spark, str(tmp_path))
    want = con.execute(catalog.RUNS_SQL)
    assert [c[0] for c in want.description] == got.columns
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())


def test_planting_leaves_other_documents_alone(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", F.lit(1).alias("w"))
    both = catalog.with_planted_runs(docs).alias("a").join(docs.alias("b"), "doc_id").select("doc_id", (F.col("a.text") == F.col("b.text")).alias("same"))
    assert all(r.same for r in both.collect() if __import__("zlib").crc32(str(r.doc_id).encode()) % 10)
