"""Ranked lexical search against a plain scorer, its SQL twin, and odd rows."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from duoscreen.llm import catalog, lexical


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain(docs, items, k):
    """Every document's score for every item, (item_id, rank, doc_id, score)."""
    bags = [(d, Counter(words(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, terms in {(i, frozenset(words(t))) for i, t in items}:
        scores = []
        for d, b, n in bags:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            weight = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            score = sum(weight(t) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 20 * m)) for t in terms if t in b)
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if gone else d, -s) for r, (s, gone, d) in enumerate(sorted(scores)[:k])]
    return Counter(out)


def made_up(seed, n):
    rng = random.Random(seed)
    vocabulary = [a + b for a in "xyzé" for b in "klmn"] + ["the"] * 12 + ["of"] * 6
    docs = [(i if i % 11 else None, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 40)))) for i in range(n)]
    docs += [(1000, None), (1001, ""), (1002, "!?"), (1003, "THE Of, xk-yl xk"), (1003, "THE Of, xk-yl xk"), (1004, "é É İ ß42")] + [(2000 + i, "same words here xk") for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 9)))) for i in range(12)]
    items += [(50, "unknown"), (51, None), (52, "..."), (53, "the the the"), (54, "xk same"), (54, "xk same"), (54, "of"), (55, "same xk"), (None, "É ß42"), (56, "THE")]
    return docs, items


@pytest.mark.parametrize("k, rows", [(5, 1 << 15), (50, 7), (1, 3)])
def test_equals_the_plain_scorer(spark, monkeypatch, k, rows):
    monkeypatch.setattr(lexical, "CHUNK_ROWS", rows)
    monkeypatch.setattr(lexical, "FIRST_READ", 1)
    docs, items = made_up(k, 150)
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, score int").repartition(3)
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, digest string")
    assert Counter(map(tuple, lexical.search(d, i, k).collect())) == plain(docs, items, k)


def test_blocks_of_items_and_empty_tables(spark):
    docs, items = made_up(9, 60)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert Counter(map(tuple, lexical.search(d, i, 4, block_bytes=300).collect())) == plain(docs, items, 4)
    for got in (lexical.search(d.limit(0), i), lexical.search(d, i.limit(0)), lexical.search(d, i.filter("item_id in (51, 52)"))):
        assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_twin_on_odd_rows(spark, tmp_path):
    docs, items = made_up(4, 200)
    con = duckdb.connect()
    for name, column, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        spark.createDataFrame(rows, f"{column} long, text string").write.parquet(str(tmp_path / f"{name}.parquet"))
        con.execute(f"CREATE TABLE {name} ({column} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    got = catalog.op11(spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == Counter(con.execute(catalog.LEXICAL_SQL).fetchall())


def test_reading_stops_early_and_not_on_a_tie():
    rng = np.random.default_rng(3)
    n = 20_000
    docs = np.concatenate([np.arange(n), rng.permutation(n)[:50]])
    terms = np.concatenate([np.zeros(n, np.int64), np.ones(50, np.int64)])
    impacts = np.concatenate([rng.integers(1, 1000, n), rng.integers(5000, 9000, 50)])
    lists = lexical.Lists(terms, docs, impacts, 2)
    at, scores = lexical.best_positions(lists, [0, 1], n, 10, np.zeros(0, np.int64))
    whole = np.zeros(n, np.int64)
    np.add.at(whole, docs, impacts)
    assert len(at) < n // 10 and sorted(scores)[-10:] == sorted(whole)[-10:] and (whole[at] == scores).all()
    tied = lexical.Lists(np.zeros(n, np.int64), np.arange(n), np.full(n, 7), 1)
    at, _ = lexical.best_positions(tied, [0], n, 10, np.zeros(0, np.int64))
    assert len(at) == n


def test_terms_equal_the_expression(spark):
    texts = ["A-b_c'd 12é É İK\x00x\x7fy\x85z~", "", "ß", "a b", "日本 語"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", lexical.term_array(F.col("text")).alias("t")).collect()
    assert all([w.encode() for w in r.t] == lexical.terms_of(r.text.encode()) and r.t == words(r.text) for r in got)


def test_query_on_the_small_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert Counter(map(tuple, catalog.op11(spark, SMALL).collect())) == plain(docs, items, 50)
