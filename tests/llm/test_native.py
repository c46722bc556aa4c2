"""Quotation linking, URL filters, license scans and mixing: small cases with known answers."""

import math
import random
import re

import brute
import duckdb
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from duoscreen.llm import catalog, licenses, mixing, quotation, topk, urls


def test_quotes_link_to_the_earliest_message(spark):
    rows = [
        (1, 0, "user", "Hello  there.\n\nHow are you?"),
        (1, 1, "bot", "> how are YOU?\nFine, thanks."),
        (1, 2, "user", ">> How are you?\n> fine, thanks.\nGood.\n> never said\nBye"),
        (1, 3, "bot", "How are you?"),
        (1, 4, "user", "> Hello there.\n> Something else\n> How are you?\nboth"),
        (1, 5, "bot", "> Good.\n> Bye"),
        (2, 0, "user", "> How are you?\nother conversation"),
        (2, 1, None, None),
        (None, 1, "user", "> Hello there."),
        (2, 1, None, None),
    ]
    got = quotation.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 9
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[1, 1].text == "Fine, thanks." and by[1, 1].parent_turn == 0 and by[1, 1].depth == 1
    assert by[1, 2].parent_turn == 1 and by[1, 2].root_turn == 0 and by[1, 2].depth == 2 and by[1, 2].max_level == 2
    assert by[1, 2].text == "Good.\nBye" and by[1, 2].n_quotes == 3 and by[1, 2].n_linked == 2
    assert by[1, 3].parent_turn is None and by[1, 3].root_turn == 3
    assert by[1, 4].parent_turn == 0 and by[1, 4].text == "both"
    assert by[1, 5].parent_turn == 2 and by[1, 5].depth == 3 and by[1, 5].root_turn == 0 and by[1, 5].text == ""
    assert by[2, 0].parent_turn is None and by[2, 0].n_quotes == 1 and by[2, 0].n_linked == 0
    assert by[2, 1].text == "" and by[None, 1].parent_turn is None
    order = [(r.root_turn, r.turn) for r in got if r.conv_id == 1]
    assert order == sorted(order)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert {tuple(r) for r in got} == set(con.execute(catalog.QUOTE_SQL).fetchall())


def test_long_reply_chains(spark):
    rows = [(1, 0, "u", "m0")] + [(1, i, "u", f"> m{i - 1}\nm{i}") for i in range(1, 70)]
    got = quotation.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all(r.depth == r.turn and r.root_turn == 0 for r in got)
    assert quotation.threads(spark.createDataFrame([], "conv_id long, turn long, role string, text string, msg int")).count() == 0


def test_conversations_without_quotes(spark):
    conversations = spark.read.parquet(f"{SMALL}/conversations.parquet")
    got = catalog.op1(spark, SMALL)
    assert got.count() == conversations.distinct().count()
    assert got.where("text is null or root_turn is null").count() == 0


def fits(rule, url):
    host, path = split(url)
    return (host == rule[0] or host.endswith("." + rule[0])) and path.startswith(rule[1])


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


def test_url_rules(spark):
    rules = [*catalog.URL_RULES, ("org", "/a", "block"), ("example.org", "", "block"), ("deep.example.org", "/x/y/z", "allow"), ("é.org", "/", "block")]
    hosts = ["example.com", "www.Example.com", "a.b.www.example.com", "example.net", "net", "x.org", "EXAMPLE.org", "deep.example.org", "notexample.com", "é.org", "É.org", ""]
    paths = ["", "/", "/en/", "/en", "/es/1//2", "/abc", "/x/y/zz", "/" * 3000, "/en/?q=/es/", "?a=/en/", "#/en/"]
    found = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme/en/", "a://b://example.com/en/", "http://example.com/en/"]
    rows = [(i, u, "old") for i, u in enumerate(found)] + [(0, found[0], "old")]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = urls.verdicts(pages, table).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = split(r.url)
        best = max((x for x in rules if fits(x, r.url)), key=lambda x: (len(x[0] + x[1]), len(x[0]), x[2] == "block"), default=None)
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == ((best[0] + best[1], best[2]) if best else (None, "allow")), r.url
    assert urls.verdicts(pages, table.limit(0)).where("rule is not null or verdict != 'allow'").count() == 0
    assert urls.verdicts(pages.limit(0), table).count() == 0


def test_license_places_match_brute_force(spark):
    rng = random.Random(6)
    words = ["MIT", "License", "apache", "cc", "BY", "gnu", "general", "public", "the", "é", "K", "2", "gnu general public license", "CC-BY-NC"]
    texts = [None, "", " ", "MIT", "mit license", "mit licenSe.", "the MİT license", "mit K license", "CC BY" * 2000]
    texts += [rng.choice([" ", "\n", "--", ", "]).join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "mit license", 1), (4, "mit license", 1)]
    rows += [(1000 + r.doc_id, r.text, 1) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, digest int")).collect()
    assert len(got) == len(rows) - 1
    found = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got}
    assert found == {d: brute.license_base(t) for d, t, _ in rows}
    for r in got:
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert (r.score == 1) or not r.base_labels


def test_notices_with_small_changes(spark):
    words = licenses.NOTICES[0][1].split()
    near = [*words[:10], "really", *words[10:]]
    far = words[:6] + ["x"] * 20
    rows = [(1, " ".join(words)), (2, "Copyright.\n" + " ".join(near).upper() + " more"), (3, " ".join(far))]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "mit" and got[1].score == 1 and got[2].labels == "mit" and 0.7 <= got[2].score < 1
    assert got[3].labels == "" and 0 < got[3].score < 0.7
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def apportioned(votes, seats):
    won = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = max(votes, key=lambda p: (votes[p] / (2 * won[p] + 1), [-x for x in p]))
        won[best] += 1
    return won


def test_highest_quotients(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for g in range(12):
        n = rng.randint(1, 9)
        votes = {(g, i): rng.choice([0, 1, 3, 10, 500, rng.randint(1, 100000)]) for i in range(n)}
        seats = rng.choice([0, 1, 2, 7, 100, 301])
        rows += [(g, i, v, seats) for (_, i), v in votes.items()]
        want |= apportioned(votes, seats if sum(votes.values()) else 0)
    got = mixing.apportion(spark.createDataFrame(rows, "g int, i int, v long, s long"), ["g"], "s", "v", ["i"]).collect()
    assert {(r.g, r.i): r.won for r in got} == want


def test_mix_of_odd_tables(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " x  y\n", None), (3, " x  y\n", None), (None, "z " * 3000, "b"), (5, "w " * 900, "b"), (6, "v " * 50, "c"), (7, "u " * 70, "é")]
    schema = "doc_id long, text string, source string"
    got = mixing.mix(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert sorted(r["size"] for r in got) == [0, 0, 2, 2, 50, 70, 900, 3000]
    by = {r.source: (r.source_size, r.target) for r in got}
    total = sum(r["size"] for r in got)
    assert sum(t for _, t in by.values()) == pytest.approx(1.5 * total) and all(t <= 2 * s for s, t in by.values())
    for source, (size, target) in by.items():
        assert abs(sum(r.taken for r in got if r.source == source) - target) <= 64 + 1
    again = mixing.mix(spark.createDataFrame(rows, schema).repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0


#: The whole text of a license (fixed value).
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to
do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_templates_of_any_length(spark):
    """A whole license and one of 200 words, against a count of the template's grams in the text."""
    rng = random.Random(31)
    words = [f"w{rng.randrange(150)}" for _ in range(200)]
    mit = re.findall(r"[a-z0-9]+", MIT.lower())
    assert len(mit) > 160
    changed, longer = list(words), words[:90] + ["extra"] + words[90:]
    for i in (3, 70, 71, 150, 199):
        changed[i] = "other"
    texts = [f"intro text here\n{MIT}\nend", "a b " + " ".join(words), "c " + " ".join(changed) + " d", " ".join(longer), " ".join(words[:120]), " ".join(words) + " mid " + " ".join(words)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), {}, [("mit", " ".join(mit)), ("long", " ".join(words))]).collect()}

    def share(text):
        own = text.split()
        grams = {tuple(own[i : i + 3]) for i in range(len(own) - 2)}
        return sum(tuple(words[i : i + 3]) in grams for i in range(198)) / 198

    assert got[0].labels == "mit" and got[0].score == 1.0
    for i, text in enumerate(texts[1:], start=1):
        assert got[i].score == pytest.approx(share(text)) and got[i].labels == ("long" if share(text) >= 0.7 else ""), i
    assert got[1].score == 1.0 and got[2].score < 1 and got[4].labels == ""


def test_whole_mix_takes_targets_to_the_word(spark):
    """Sources of a few words, a source at its limit, and a third of the rows without an id."""
    rng = random.Random(21)
    rows = [(i if i % 3 else None, "w " * rng.randrange(1, 120) + f"x{i}", f"s{i % 4}") for i in range(900)]
    rows += [(2000, "ten words " * 5, "tiny"), (2001, "one", "one"), (2002, None, "empty"), (2003, "y " * 30_000, "a"), (2004, "v " * 7, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(frame, whole=True).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert sum(r.taken for r in own) == round(own[0].target + 1e-9), source
    assert sum(r.taken for r in got if r.source == "tiny") > 0
    again = mixing.mix(frame.repartition(5), whole=True).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    keys = mixing.sizes(frame, whole=True).groupBy("key").count().agg(F.max("count")).first()[0]
    assert keys == 1 and mixing.mix(frame.limit(0), whole=True).count() == 0


def test_topk_of_odd_vectors(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(24)], 1) for i in range(120)]
    rows += [(200, None, 1), (250, [None] * 24, 1), (300, [float("nan")] * 24, 1), (350, [float("inf")] + [0.0] * 23, 1), (400, [1e9] * 24, 1), (450, [1.0] * 3, 1), (452, [2.0] * 3, 1)]
    rows += [(100, rows[100][1], 1), (1000, rows[7][1], 1), (1001, rows[7][1], 1), (None, rows[7][1], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    finite = [r for r in frame.collect() if r.embedding and all(x is not None and abs(x) < float("inf") for x in r.embedding)]
    usable = [(r.vec_id, [math.floor(256 * x) for x in r.embedding]) for r in finite]
    got = topk.search(frame, F.col("vec_id") % 50 == 0).collect()
    queries = {i: v for i, v in usable if i is not None and i % 50 == 0}
    for q, v in queries.items():
        scores = [(sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q and len(w) == len(v)]
        want = sorted(scores, key=lambda s: (-s[0], s[1] if s[1] is not None else -(1 << 63)))[:5]
        assert [(r.score, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == want
    assert {r.query_id for r in got} == set(queries)
    assert topk.search(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("name", [n for n, (_, sql) in catalog.QUERIES.items() if sql])
def test_queries_match_sql(spark, name):
    from duoscreen.catalog.check import rows_of

    run, sql = catalog.QUERIES[name]
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    frame = run(spark, SMALL)
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(names, cursor.fetchall())
