"""Main text of web pages by composite text density.

A page is read into a tree of elements.  Each node gets the density of its
text: characters per tag, adjusted by the characters and tags of links, so
that menus and link lists score low (Sun, Song and Liao, "DOM based content
extraction via text density", SIGIR 2011).  A node's density sum adds up the
densities of its children.  The node of greatest density is found; the least
density on its path to the body is the threshold, and the subtree of greatest
density sum among the blocks at or over it is the article, with the siblings
that reach the threshold too.  Inside it, lists of links under the threshold
go.  Before that, elements go that HTML itself calls no article (menus, forms,
scripts, asides, ...), and containers named after prose that no density can
tell from an article: adverts, notices, side columns, comments of readers.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common as c

#: Fixed values of HTML: elements without an end, with raw text, and those that start a block of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold no article text.
DROPPED = frozenset("script style noscript template iframe nav footer aside form button input select option textarea svg canvas object embed video audio map dialog menu head title link meta noframes xmp".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
#: Whole parts of class and id names of containers whose prose is as dense as an article's.
NAMES = frozenset("ad ads advert adverts advertisement advertisements sponsor sponsored promo banner comment comments commentlist respond disqus replies cookie cookies consent gdpr notice newsletter popup modal sidebar".split())
#: Elements that say nothing themselves; only of these does a name decide.
CONTAINERS = frozenset("div section ul ol dl table center ins".split())
#: Beside these, a name says what surrounds an element, or that it lacks something.
QUALIFIED = frozenset("has with no without".split())
#: A start tag of the key closes an open element of the value.
CLOSES = {
    **dict.fromkeys("address article aside blockquote details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split(), frozenset({"p"})),
    "li": frozenset({"li", "p"}),
    "dt": frozenset({"dt", "dd", "p"}),
    "dd": frozenset({"dt", "dd", "p"}),
    "tr": frozenset({"tr", "td", "th", "p"}),
    "td": frozenset({"td", "th", "p"}),
    "th": frozenset({"td", "th", "p"}),
    "option": frozenset({"option"}),
    "thead": frozenset({"tr", "td", "th"}),
    "tbody": frozenset({"thead", "tr", "td", "th"}),
}
#: Elements beyond which an implied end doesn't reach.
SCOPE = frozenset("html body table ul ol dl article section main aside nav div td th form blockquote header footer button".split())

TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "children", "parent", "chars", "tags", "link_chars", "link_tags", "density", "total", "order")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children = tag, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _unwanted(tag: str, attributes: str, depth_in_article: int) -> bool:
    if tag in DROPPED or (tag == "header" and not depth_in_article):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "role" and value.lower() in ROLES:
            return True
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id") and tag in CONTAINERS:
            for one in value.split():
                parts = {p.lower() for p in PART.findall(one)}
                if parts & NAMES and not parts & QUALIFIED:
                    return True
    return False


@cache
def _end_of(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


def parse(page: str) -> Node:
    """The tree of a page without what can't be article; children are nodes and texts."""
    root = Node("html", None)
    body = Node("body", root)
    root.children.append(body)
    here, at, skipped, inside = body, 0, [], 0
    unclosed: set[str] = set()  # raw elements whose end doesn't come any more

    def text(raw: str) -> None:
        if raw and not skipped:
            here.children.append(entities.unescape(raw) if "&" in raw else raw)

    n = len(page)
    while at < n:
        mark = page.find("<", at)
        if mark < 0:
            text(page[at:])
            break
        m = TOKEN.match(page, mark)
        if not m or (m.end() == n and not page.endswith(">") and m[2] is None and not page.startswith("<!", mark)):
            text(page[at : mark + 1])
            at = mark + 1
            continue
        text(page[at:mark])
        at = m.end()
        if not m[2]:
            if page.startswith("<![CDATA[", mark):
                text(page[mark + 9 : at - 3])
            continue
        tag = m[2].lower()
        if m[1]:
            if skipped:
                if tag in skipped:
                    while skipped.pop() != tag:
                        pass
                elif tag in ("article", "main", "body", "html"):
                    skipped.clear()
            if not skipped and tag not in ("body", "html"):
                up = here
                while up is not body and up.tag != tag:
                    if up.tag in SCOPE and tag not in SCOPE:
                        up = body
                        break
                    up = up.parent
                if up is not body:
                    while here is not up:
                        inside -= here.tag in ("article", "main")
                        here = here.parent
                    inside -= here.tag in ("article", "main")
                    here = here.parent
            continue
        if tag in ("html", "body", "head") and not (tag == "head"):
            continue
        if tag in RAW or tag == "script":
            close = None if tag in unclosed else _end_of(tag).search(page, at)
            if close is None:
                unclosed.add(tag)
            at = close.end() if close else (n if tag in ("script", "style") else at)
            continue
        empty = tag in VOID or m[3].rstrip().endswith("/") and tag in ("svg", "path")
        if skipped:
            if not empty:
                if tag in CLOSES and skipped[-1] in CLOSES[tag] and len(skipped) > 1:
                    skipped.pop()
                skipped.append(tag)
            continue
        if tag in CLOSES:
            up = here
            while up is not body and (up.tag in CLOSES[tag] or up.tag not in SCOPE):
                if up.tag in CLOSES[tag]:
                    here = up.parent
                up = up.parent
        if _unwanted(tag, m[3], inside):
            if not empty:
                skipped.append(tag)
            continue
        node = Node(tag, here)
        here.children.append(node)
        if not empty:
            here = node
            inside += tag in ("article", "main")
    return root


def _measure(root: Node) -> list[Node]:
    """Characters and tags of all nodes, of links too; the nodes in page order."""
    order: list[Node] = []
    stack = [(root, False)]
    while stack:
        node, link = stack.pop()
        order.append(node)
        inner = link or node.tag == "a"
        for x in reversed(node.children):
            if isinstance(x, Node):
                stack.append((x, inner))
        own = sum(len(SPACE.sub("", x)) for x in node.children if isinstance(x, str))
        node.chars += own
        if inner:
            node.link_chars += own
    for node in reversed(order):
        up = node.parent
        if up is not None:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags + (node.tag == "a")
    return order


def main_node(root: Node) -> Node:
    """The subtree of greatest density sum, under the threshold of the body path; link lists in it are taken out."""
    order = _measure(root)
    body = root.children[0]
    ratio = body.link_chars / max(body.chars, 1)
    for node in order:
        chars, tags = node.chars, max(node.tags, 1)
        if not chars:
            continue
        plain = max(chars - node.link_chars, 1)
        base = math.log(chars / plain * node.link_chars + ratio * chars + math.e)
        inner = chars / max(node.link_chars, 1) * tags / max(node.link_tags, 1)
        node.density = chars / tags * max(math.log(max(inner, 1.0)) / base, 0.0)
    # blocks alone are nodes of the sum: what is inline belongs to its block, and a block of words to itself
    blocks_ = [x for x in order if x is not root and x.tag not in INLINE]
    for node in reversed(blocks_):
        node.total = node.total or node.density
        up = node.parent
        while up is not root and up.tag in INLINE:
            up = up.parent
        up.total += node.density
    # of the path from the block of greatest sum to the body, the least density
    best = max(blocks_, key=lambda x: x.total, default=body)
    threshold, up = best.density, best
    while up is not root:
        threshold = min(threshold, up.density)
        up = up.parent
    best = max((x for x in blocks_ if x.density >= threshold), key=lambda x: x.total, default=body)
    # a part of the text that is split over the subtree's siblings belongs to it
    while best is not body and any(isinstance(x, Node) and x is not best and x.chars and x.density >= threshold and x.tag not in INLINE for x in best.parent.children):
        best = best.parent
    _drop_links(best, threshold)
    return best


def _drop_links(node: Node, threshold: float) -> None:
    """Takes blocks under the threshold that are links for the most part, of two links or more, out of a subtree."""
    stack = [node]
    while stack:
        x = stack.pop()
        x.children = [y for y in x.children if isinstance(y, str) or y.tag in INLINE or y.density >= threshold or y.link_tags < 2 or 2 * y.link_chars <= y.chars]
        stack.extend(y for y in x.children if isinstance(y, Node))


def blocks(node: Node) -> list[str]:
    """The blocks of text under a node in page order, white space made single, ends trimmed."""
    out: list[str] = []
    now: list[str] = []

    def close() -> None:
        if now:
            text = SPACE.sub(" ", "".join(now)).strip()
            now.clear()
            if text:
                out.append(text)

    stack: list[object] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            now.append(x)
        elif x.tag in INLINE:
            stack.extend(reversed(x.children))
        else:
            close()
            stack.append(None)
            stack.extend(reversed(x.children))
    close()
    return out


def main_text(page: str | None) -> str:
    """The article of a page as one line; empty for null, empty and textless pages."""
    if not page:
        return ""
    return " ".join(blocks(main_node(parse(page))))


def extract(pages: DataFrame) -> DataFrame:
    """pages with ``text`` and ``n_chars`` (code points) of the article.

    Null and empty pages have empty texts.  A page is read whole and in linear
    time, however long, and its tree is all that a task holds beside a batch.
    White space is what Unicode calls so, non-breaking spaces included.  Rows
    are read on their own, so ties and repeated rows don't matter; an empty
    table gives an empty one.  All columns stay; the new ones get a trailing
    underscore where pages has such a name already.
    """
    c.small_batches(pages.sparkSession)
    text, size = c.fresh(pages, "text"), c.fresh(pages, "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=[*b.schema.names, text, size])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(text, T.StringType()), T.StructField(size, T.LongType())]))
