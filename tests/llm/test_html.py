"""Main text extraction: marked pages, pages that only the style tree can judge, and broken markup."""

import html

from conftest import SMALL

from duoscreen.llm import catalog, html_tree

SCHEMA = "page_id long, url string, html string, text string"


def extracted(spark, rows):
    return {r.page_id: r for r in html_tree.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_marked_pages(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="ad-banner">Buy</div>
    <article><h1>Title &amp; more</h1><p>One   <b>two<br>three &#233;&nbsp;x</p><p class=x>Four<p>Five &lt;p&gt;
    <div class="share-buttons">Share</div><ul><li>a<li>b</ul><form><input>Name</form><!-- c <p>no</p> -->
    <section id="comments"><p>Great post</p></section></article><aside>Side</aside><footer>&copy; x</footer>"""
    got = extracted(spark, [(1, "http://a.b/c", page, "old"), (2, None, None, None), (3, "", "", ""), (4, "http://a.b/d", "plain & text", "")])
    assert got[1].text == "Title & more\nOne two three é x\nFour\nFive <p>\na\nb"
    assert got[1].n_chars == len(got[1].text) and got[2].text == "" and got[3].text == "" and got[4].text == "plain & text"


def test_style_tree_finds_repeated_branches(spark):
    def page(i):
        body = "".join(f"<p>Paragraph {i} {k} of its own</p>" for k in range(4))
        return f"<body><div class=q1>Same words on all pages</div><div class=q2>{body}</div><div class=q3><span>Call us</span></div></body>"

    rows = [(i, f"http://host.example/{i}", page(i), "") for i in range(6)] + [(9, "http://other.example/", page(9), ""), (0, "http://host.example/0", page(0), "")]
    found = html_tree.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    for r in found:
        own = "\n".join(f"Paragraph {r.page_id} {k} of its own" for k in range(4))
        assert r.text == (own if r.page_id < 6 else f"Same words on all pages\n{own}\nCall us")


def test_style_tree_judges_containers_inside_main(spark):
    def page(i):
        return f"<main><h1>Title {i}</h1><p>Text {i}</p><div class=z9>Read our other posts</div><div class=z8>Box {i}</div><p>Same line</p></main><div>out {i}</div>"

    rows = [(i, f"http://one.example/{i}", page(i), "") for i in range(5)]
    for r in html_tree.extract(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r.text == f"Title {r.page_id}\nText {r.page_id}\nBox {r.page_id}\nSame line"


def test_style_tree_judges_every_branch_of_main(spark):
    def page(i):
        return f"<nav>Home</nav><article><h1>Title {i}</h1><p>Text {i}<blockquote>Read our other posts</blockquote><p>More {i}</article><p>out {i}"

    rows = [(i, f"http://one.example/{i}", page(i), "") for i in range(5)]
    for r in html_tree.extract(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r.text == f"Title {r.page_id}\nText {r.page_id}\nMore {r.page_id}"


def test_copies_under_many_urls_are_one_page(spark):
    def page(i):
        return f"<div class=q1>Same words</div><div class=q2><p>Text {i}</p><ul><li>Point {i}</ul></div>"

    rows = [(i, f"http://one.example/{i}", page(0), "") for i in range(8)]
    assert {r.text for r in extracted(spark, rows).values()} == {"Same words\nText 0\nPoint 0"}
    rows += [(20 + i, f"http://one.example/{20 + i}", page(20 + i), "") for i in range(2)] + [(30, "http://two.example/", page(0), "")]
    for r in extracted(spark, rows).values():
        n = r.page_id if 20 <= r.page_id < 30 else 0
        assert r.text == ("Same words\n" if r.page_id == 30 else "") + f"Text {n}\nPoint {n}"


def test_broken_and_long_markup(spark):
    odd = ["<p>a<p", "<<<>>> x </div></div> y", '<a title="b>c</a> d', "<script>never closed", "<p>" * 5000 + "deep" + "</div>" * 50, "<div>" * 3000 + "z", "&#x110000; &bogus; &amp", "<p>" + "w " * 200000]
    got = extracted(spark, [(i, "http://h/", h, "") for i, h in enumerate(odd)])
    assert got[0].text.startswith("a") and got[4].text == "deep" and got[5].text == "z" and got[3].text == ""
    assert got[7].n_chars == 399999
    assert html_tree.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pages_of_the_table(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in catalog.op8(spark, SMALL).collect():
        article = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        assert r.n_chars == len(r.text) and r.text.split("\n")[0] in " ".join(html.unescape(article).split())
        assert "&copy;" not in r.text and "<" not in r.text.replace("< ", "") and "track(" not in r.text


def text_of(page):
    return html_tree.main_text(html_tree.parsed(page), set())


def test_marks_are_evidence_and_lose_no_article():
    body = "<h1>T</h1><p>Long article body here.</p>"
    want = "T\nLong article body here."
    assert text_of(f'<div class="layout with-sidebar">{body}</div>') == want
    assert text_of(f'<div class="sidebar">{body}</div><nav><a href=x>Home</a></nav>') == want
    assert text_of(f'<form id="aspnetForm"><div class="menu"><a href=x>A very long link text in the menu</a></div>{body}</form>') == want
    assert text_of('<p>Real article text.</p><p>More.</p><div class="story"><p>teaser</p></div>') == "Real article text.\nMore.\nteaser"
    assert text_of('<div class="story"><p>Real article text.</p><p>More.</p></div><p>teaser</p>') == "Real article text.\nMore."
    assert text_of(f'<article>{body}<div class="share-price">Up 3 %</div><div class="share-buttons">Tell all</div></article>') == f"{want}\nUp 3 %"
    assert text_of(f"<div><article>Card</article></div><div>{body} and so on and on</div>") == f"Card\n{want.split(chr(10))[0]}\nLong article body here.\nand so on and on"
    assert text_of('<header class="entry-header"><h1>T</h1></header>') == "T" and text_of('<main><div class="post-header"><h1>T</h1></div><p>x</p></main>') == "T\nx"


def test_long_comments_and_menus_stay_out():
    article, comment = "<p>Short article.</p>", "<p>One long comment of a reader, longer than all the rest.</p>" * 5
    for name in ("comments", "comment-list", "reader-comments", "disqus_thread"):
        assert text_of(f'<div>{article}</div><div id="{name}">{comment}</div>') == "Short article."
    assert text_of(f"<article>{article}</article><aside>{comment}</aside>") == "Short article."
    assert text_of(f"<main>{article}</main><footer>{comment}</footer>") == "Short article."


def test_deep_markup_takes_memory_in_proportion():
    import tracemalloc

    for page in ("<div>" * 100_000 + "x", '<div class="ad">' * 50_000 + "x"):
        tracemalloc.start()
        found = html_tree.kept(html_tree.parsed(page))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert [b.text for b in found] == ["x"] and most < 100e6


def test_importance_equals_a_plain_tree(spark):
    """The merged tree by hand: nodes named by written-out paths, entropies from plain counts."""
    import math
    import random
    from collections import Counter, defaultdict

    rng = random.Random(5)
    nodes, rows = defaultdict(lambda: (defaultdict(Counter), set())), []
    for page in range(12):
        host = f"h{page % 2}.example"
        inner = [(rng.choice(["p", "ul", "h2"]), rng.choice(["same words", f"own {page} {k}"])) for k in range(rng.randrange(1, 7))]
        rows.append((page, f"http://{host}/{page}", "<section>" + "".join(f"<{t}>{x}</{t}>" for t, x in inner) + "</section>", ""))
        steps = {"/section": ({"".join(f"{t} " for t, _ in inner)}, set())}
        for tag, words in inner:
            styles, texts = steps.setdefault(f"/section/{tag}", ({""}, set()))
            texts.add(words)
        for path, (styles, texts) in steps.items():
            kinds, pages = nodes[host, path]
            pages.add(page)
            kinds[0].update(styles)
            kinds[1].update(texts)
    want = []
    for (host, path), (kinds, pages) in nodes.items():
        n = len(pages)
        style = -sum(c / kinds[0].total() * math.log(c / kinds[0].total()) for c in kinds[0].values()) / math.log(n) if n > 1 else 1.0
        content = (1 - sum(c * math.log(c) for c in kinds[1].values()) / kinds[1].total() / math.log(n) if n > 1 else 1.0) if kinds[1] else style
        want.append((host, n, 0.1 * style + 0.9 * content))
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("regexp_extract(url, '//([^/]*)', 1) as host", "page_id as page", "html")
    got = [(r.host, r.n_pages, r.importance) for r in html_tree.importance(html_tree.style_nodes(docs)).collect()]
    assert len(got) == len(want)
    for (a, n, x), (b, m, y) in zip(sorted(got), sorted(want)):
        assert (a, n) == (b, m) and abs(x - y) < 1e-9
