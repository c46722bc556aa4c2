"""Quality rules against a plain version, their SQL twin, and odd rows."""

import random
import re
from collections import Counter

import duckdb
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from duoscreen.llm import catalog, quality

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COLUMNS = ["doc_id", *NAMES, "base_failed", "failed", "kept"]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def odd_rows():
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a", "a b c", "a a a", "a a a a", "x y z x y z", "x y z q x y z q x", "the | of # " * 30, "- a\n- a\n* b\n\n \n- a", "é ü\r\né ü\r\n", "a\x85b c d", "\x0b\x0ca b\x1fc"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(3, 90))) for _ in range(40)]
    texts.append("the of and " * 20_000)
    return [(i if i != 7 else None, t, "extra") for i, t in enumerate([*texts, "x y z x y z"])]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), "doc_id long, text string, n_words string")


def test_measures_equal_the_plain_version(spark, odd):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    for rows in (docs, odd.drop("doc_id").withColumn("doc_id", F.xxhash64("text"))):
        texts = {(r.doc_id, r.text) for r in rows.collect()}
        got = {r.doc_id: r for r in quality.judge(rows).collect()}
        for doc, text in texts:
            assert tuple(got[doc][n] for n in NAMES) == plain(text), text


def test_twin_on_odd_rows(odd):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in odd_rows()])
    got = quality.judge(odd).withColumn("failed", F.array_join("failed", ",")).select(*COLUMNS)
    assert Counter(map(tuple, got.collect())) == Counter(con.execute(catalog.QUALITY_SQL).fetchall())


def test_equal_hashes_of_different_words_go_by_words(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcd") for _ in range(30)) for _ in range(20)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.coalesce(F.length(c[0]), F.lit(0)).cast("long") * 0)
    got = {r.doc_id: r.n_repeat_words for r in quality.judge(rows).collect()}
    assert got == {i: plain(t)[4] for i, t in enumerate(texts)}


def test_rules_of_a_table_of_ones_own(spark):
    rows = spark.createDataFrame([(1, "one two"), (2, "one two three"), (2, "one two three"), (None, None)], "doc_id long, text string")
    rules = [quality.Rule("long", "n_words", high=2), quality.Rule("wordy", "word_chars", "n_words", low=300)]
    got = sorted(((r.doc_id, r.failed, r.kept, r.base_failed) for r in quality.judge(rows, rules, []).collect()), key=str)
    assert got == sorted([(1, [], True, False), (2, ["long"], False, False), (2, ["long"], False, False), (None, [], True, False)], key=str)
    assert quality.judge(rows.limit(0)).count() == 0


def test_one_projection_without_user_functions(spark):
    plan = quality.judge(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Generate", plan)
