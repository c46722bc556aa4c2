"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged into one tree whose nodes are tag paths. A node's importance combines two
entropies over the pages that have it: of its presentation (which child tags it holds) and of its content (texts
that stand on many of the pages are noise, texts of one page are content). The tree judges every branch of every
page, and a page loses those that it finds unimportant. Marks come on top, as evidence: a branch whose tag or names say
that it is noise goes unless it holds the page, and where a page marks its main element, what lies outside goes. What
holds the page is told by text outside links.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscreen.llm.common import pieces, stage
from duoscreen.llm.urls import host_of

#: Weight of a node's own presentation against its content.
PRESENTATION = 0.1
#: A branch below this importance goes.
IMPORTANCE = 0.3
#: A branch is judged if so many different pages of its host have it.
PAGES = 3

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*)>|<[!?][^<>]*>""", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

#: Elements (fixed values) whose content is no text of the page.
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "select", "xmp"}
_NOISE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "header", "head", "fieldset"}
_MAIN = {"article", "main"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
    "ruby", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "img", "wbr", "input",
}
#: Elements that an opening tag of the same group closes.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Parts of a class, id or role that speak of noise, of readers' comments (also noise), and those that say nothing (fixed values).
_COMMENT_PART = re.compile(r"comments?|disqus|repl(?:y|ies)|respond|discussion", re.I)
_NOISE_PART = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banners?|cookies?|consent|gdpr|notices?|alerts?|popup|modal|newsletter|subscri\w*|shar(?:e|ing)|social|"
    r"nav\w*|menus?|menubar|breadcrumbs?|sidebar|aside|side|footer|header|masthead|related|recommend\w*|widgets?|toolbar|pagination|"
    r"pager|login|signup|search|complementary|contentinfo",
    re.I,
)
_NEUTRAL_PART = re.compile(
    r"\d+|area|bar|block|body|bottom|box|btn|buttons?|center|col|column|container|content|count|desktop|entry|fixed|first|form|global|group|"
    r"head|heading|holder|icons?|inner|items?|last|latest|left|links?|list|main|middle|mobile|module|more|outer|overlay|page|panel|placeholder|"
    r"popular|posts?|articles?|primary|reader|right|row|secondary|section|site|slot|sticky|stor(?:y|ies)|tags?|text|thread|title|toggle|top|unit|user|"
    r"view|wrap|wrapper",
    re.I,
)
_MAIN_NAME = re.compile(r"(?:article|main|content|post|entry|story)(?:[-_](?:article|body|content|text|main|area|wrap|wrapper|container|inner))*|articlebody", re.I)
#: A header of one of these stands over the main text.
_TITLED = {"post", "article", "entry", "story", "content", "main"}
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")


@lru_cache(1 << 16)
def marked_noise(name: str) -> str:
    """noise, comment or empty, for one class, id or role: some part speaks of it and no part of anything else."""
    parts = [p for p in _PARTS.split(name) if p]
    noise = [p for p in parts if _NOISE_PART.fullmatch(p)]
    comment = [p for p in parts if _COMMENT_PART.fullmatch(p)]
    if not noise and not comment or not all(p in noise or p in comment or _NEUTRAL_PART.fullmatch(p) for p in parts):
        return ""
    if not comment and all(p.lower() == "header" for p in noise) and any(p.lower() in _TITLED for p in parts):
        return ""
    return "comment" if comment else "noise"


@dataclass
class Block:
    """A run of text: hash of its tag path, innermost noise mark and main mark (0: none), characters outside links."""

    path: int
    mark: int
    main: int
    text: str
    plain: int
    title: bool


@dataclass
class Parsed:
    """Blocks of a page in order, each element's path and a hash of its children's steps, and the marks: parent and kind."""

    blocks: list[Block]
    styles: list[tuple[int, int]]
    marks: list[tuple[int, str]]
    mains: list[tuple[int, str]]


def _step(parent: int, step: bytes) -> int:
    """Hash of a path from the hash of its parent; a path is never written out, however deep."""
    return xxhash.xxh64_intdigest(step, parent)


def _signed(digest: int) -> int:
    return digest - (1 << 63)


def parsed(page: str) -> Parsed:
    """The blocks, styles and marks of a page; memory is in proportion to its length."""
    out = Parsed([], [], [(0, "")], [(0, "")])
    # tag, path, noise mark, main mark; beside it the hash of the children so far
    stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]
    children = [0]
    opened: Counter[str] = Counter()
    text: list[str] = []
    linked: list[str] = []
    link = 0  # depth at which a link was opened

    def add(found: str) -> None:
        text.append(found)
        if link:
            linked.append(found)

    def flush() -> None:
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            plain = len(words) - (len(" ".join(html.unescape("".join(linked)).split())) if linked else 0)
            text.clear()
            linked.clear()
            if words:
                tag, path, mark, main = stack[-1]
                out.blocks.append(Block(_signed(path), mark, main, words, max(0, plain), tag == "h1"))

    def close(depth: int) -> None:
        nonlocal link
        flush()
        if link > depth:
            link = 0
        while len(stack) > depth:
            tag, path, _, _ = stack.pop()
            opened[tag] -= 1
            out.styles.append((_signed(path), _signed(children.pop())))

    def depth_of(tags: set[str], stop: set[str]) -> int:
        if not any(opened.get(t) for t in tags):
            return 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                return i
            if stack[i][0] in stop:
                return 0
        return 0

    at = 0
    while at < len(page):
        token = _TOKEN.search(page, at)
        if token is None:
            add(page[at:])
            break
        if at < token.start():
            add(page[at : token.start()])
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag:
            continue
        if token[1]:
            if tag in _INLINE:
                link = 0 if tag == "a" else link
                continue
            depth = depth_of({tag}, set())
            if depth:
                close(depth)
            else:
                flush()
            continue
        if tag in _RAW and not token[3].endswith("/"):
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            at = end.end()
            text.append(" ")
            continue
        if tag in _INLINE:
            if tag == "br":
                text.append(" ")
            link = len(stack) if tag == "a" else link
            continue
        if tag in _VOID:
            flush()
            continue
        if tag in _CLOSES and (depth := depth_of(_CLOSES[tag], {"ul", "ol", "dl", "table", "select"})):
            close(depth)
        if stack[-1][0] == "p" or (tag == "body" and stack[-1][0] == "head"):
            close(len(stack) - 1)
        flush()
        _, path, mark, main = stack[-1]
        found = [(kind.lower(), a or b or c) for kind, a, b, c in _NAMES.findall(token[3])] if token[3] else []
        names = [n for _, value in found for n in value.split()]
        step = f"{tag}.{' '.join(sorted(n.lower() for n in names))}" if names else tag
        own = step.encode("utf-8", "surrogatepass")
        children[-1] = _step(children[-1], own)
        outer = tag in ("body", "html")
        kinds = {marked_noise(n) for n in names} if names and not outer and tag not in _MAIN else set()
        if tag in _NOISE and not (tag == "header" and main):
            kinds.add("noise")
        if kinds & {"noise", "comment"}:
            out.marks.append((mark, "comment" if "comment" in kinds else "noise"))
            mark = len(out.marks) - 1
        elif tag in _MAIN or ("role", "main") in [(k, v.lower()) for k, v in found]:
            out.mains.append((main, "element"))
            main = len(out.mains) - 1
        elif names and not outer and any(_MAIN_NAME.fullmatch(n) for n in names):
            out.mains.append((main, "name"))
            main = len(out.mains) - 1
        stack.append((tag, _step(path, own), mark, main))
        children.append(0)
        opened[tag] += 1
    close(1)
    return out


def _held(parents: list[tuple[int, str]], own: list[tuple[int, int]]) -> list[int]:
    """Sums of (mark, amount) over each mark and all inside it; marks are numbered from the outside in."""
    sums = [0] * len(parents)
    for mark, amount in own:
        sums[mark] += amount
    for i in range(len(parents) - 1, 0, -1):
        sums[parents[i][0]] += sums[i]
    return sums


def _inside(parents: list[tuple[int, str]], chosen: set[int]) -> list[bool]:
    """For each mark, whether it or one around it is chosen."""
    out = [False] * len(parents)
    for i in range(1, len(parents)):
        out[i] = i in chosen or out[parents[i][0]]
    return out


def kept(page: Parsed) -> list[Block]:
    """The blocks that marks leave over.

    A noise mark is void if its branch holds more than half of the page's text outside links and no main element
    outside of it has any; one of readers' comments only if the branch also holds a first heading or main element. Of the rest, main
    elements (article, main, role main) with at least a quarter of the text outside links are all that stays, else
    branches with a main name that hold more than half of it.
    """
    blocks, marks, mains = page.blocks, page.marks, page.mains
    total = sum(b.plain for b in blocks)
    in_main = _inside(mains, {i for i, (_, kind) in enumerate(mains) if kind == "element"})
    plain = _held(marks, [(b.mark, b.plain) for b in blocks])
    titles = _held(marks, [(b.mark, b.title or in_main[b.main]) for b in blocks])
    main_plain = _held(marks, [(b.mark, b.plain if in_main[b.main] else 0) for b in blocks])
    noise = {
        i
        for i, (_, kind) in enumerate(marks)
        if i and not (2 * plain[i] > total and main_plain[i] == main_plain[0] and (kind == "noise" or titles[i]))
    }
    gone = _inside(marks, noise)
    rest = [b for b in blocks if not gone[b.mark]]
    left = sum(b.plain for b in rest)
    elements = [b for b in rest if in_main[b.main]]
    if elements and 4 * sum(b.plain for b in elements) >= left:
        return elements
    named = _held(mains, [(b.main, b.plain) for b in rest])
    in_named = _inside(mains, {i for i in range(1, len(mains)) if 2 * named[i] > left})
    return [b for b in rest if in_named[b.main]] or rest


def main_text(page: Parsed, low: set[int]) -> str:
    """The blocks that neither marks nor the tree remove, one line each."""
    return "\n".join(b.text for b in kept(page) if b.path not in low)


def _hash(text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")))


def style_nodes(pages: DataFrame) -> DataFrame:
    """host, page, path, kind (0 presentation, 1 content), feature of every node of every page.

    branch is set on one row of each path of a page that has text of its own.
    """
    schema = "host string, page long, path long, kind int, feature long, branch boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "html"):
            rows = []
            for host, page, source in zip(part.column("host").to_pylist(), part.column("page").to_pylist(), texts):
                found = parsed(source.decode("utf-8", "replace"))
                seen = set()
                rows.extend((host, page, p, 0, s, False) for p, s in set(found.styles))
                for path, text in dict.fromkeys((b.path, b.text) for b in found.blocks):
                    rows.append((host, page, path, 1, _hash(text), path not in seen))
                    seen.add(path)
            if rows:
                names = [x.split()[0] for x in schema.split(", ")]
                types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return pages.mapInArrow(run, schema)


def importance(nodes: DataFrame, presentation: float = PRESENTATION) -> DataFrame:
    """host, path, n_pages and importance (0 to 1) of the merged tree's nodes.

    Presentation: entropy of the styles over the node's pages. Content: each text's pages have an entropy of
    log(pages with it) / log(pages); one less their mean is the importance. Both are 1 on a single page. Copies of
    a page count once: ``page`` names the html, whatever its URL.
    """
    single = nodes.groupBy("host", "path", "kind", "feature", "page").agg(F.lit(1).alias("one"))
    counts = single.groupBy("host", "path", "kind", "feature").agg(F.count(F.lit(1)).alias("c"))
    weighed = counts.groupBy("host", "path").agg(
        *[F.sum(F.when(F.col("kind") == k, F.col("c"))).alias(f"n{k}") for k in (0, 1)],
        *[F.sum(F.when(F.col("kind") == k, F.col("c") * F.log("c"))).alias(f"s{k}") for k in (0, 1)],
    )
    pages = nodes.select("host", "path", "page").distinct().groupBy("host", "path").agg(F.count(F.lit(1)).alias("n_pages"))
    width = F.log("n_pages")
    many = F.col("n_pages") > 1
    style = F.when(many, (F.log("n0") - F.col("s0") / F.col("n0")) / width).otherwise(1.0)
    content = F.when(many, 1 - F.col("s1") / F.col("n1") / width).otherwise(1.0)
    value = presentation * F.coalesce(style, F.lit(0.0)) + (1 - presentation) * F.coalesce(content, style, F.lit(1.0))
    return weighed.join(pages, ["host", "path"]).select("host", "path", "n_pages", value.alias("importance"))


def extract(pages: DataFrame, least: float = IMPORTANCE, n_pages: int = PAGES) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    Null html is empty and gives an empty text. Equal html on a host is one page of its tree; pages without a
    host share one tree. Repeated rows give a row each; an empty table gives an empty result; other columns are ignored.
    """
    base = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).withColumns({"host": host_of(F.col("url")), "page": F.xxhash64("html")})
    nodes = stage(style_nodes(base.select("host", "page", "html")), "style_nodes")
    low = importance(nodes).filter((F.col("n_pages") >= n_pages) & (F.col("importance") < least)).select("host", "path")
    branches = nodes.filter("branch").select("host", "path", "page")
    cut = stage(branches.join(low, ["host", "path"]).groupBy("host", "page").agg(F.collect_set("path").alias("low")), "low_branches")
    schema = "page_id long, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "html"):
            lows = part.column("low").to_pylist()
            found = [main_text(parsed(t.decode("utf-8", "replace")), set(x or ())) for t, x in zip(texts, lows)]
            columns = [part.column("page_id"), part.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    joined = base.withColumn("page_id", F.col("page_id").cast("long")).join(cut, ["host", "page"], "left")
    return joined.select("page_id", "url", "html", "low").mapInArrow(run, schema)
