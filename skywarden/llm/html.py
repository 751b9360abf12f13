"""Main text of HTML pages by tag-path ratios.

Every block of text has a tag path of block elements from the root; inline elements belong to the block around them. For each path
of a page, text length and punctuation are added up and divided by the number of blocks; the fused ratio of a block is its path's
length ratio weighted by its punctuation, averaged (geometrically) with the same smoothed over neighbouring blocks in page order.
Blocks over a share of the page's mean ratio are content, and so are headings and short blocks among them. Paths through elements
that never hold the article (menus, headers, footers, asides, forms, adverts, notices, comments) have ratio 0; paths inside a marked
article have a larger one, which decides nothing alone.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from heapq import heappop, heappush
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skywarden.llm import words

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*)>""", re.S)
NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
# fixed values: element kinds of HTML
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math"}
RAW_TAG = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
NESTED = {"svg", "math", "template"}  # may hold themselves; the text of the others ends at the first end tag
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
          "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
OUTSIDE = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "head", "object", "canvas",
           "audio", "video", "input"}
MARK = re.compile(r"ad|ads|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side|menu|nav\w*|breadcrumbs?|footer|header|cookie\w*|consent|"
                  r"notice|popup|modal|newsletter|subscribe|share|social|related|comments?|commentlist|replies|reply|respond|disqus", re.I)
PART = {"area", "bar", "block", "box", "buttons", "container", "form", "icons", "items", "links", "list", "posts", "section", "slot",
        "unit", "widget", "wrap", "wrapper"}
COMMENTS = {"comment", "comments", "commentlist", "replies"}
SAYING = {"no", "has", "with", "without", "show", "hide", "open", "allow"}  # of a page that has comments, not of the comments
UNMARKED = {"html", "body", "article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
SHARE = 0.5
WEIGHT = 1.5  # of paths in a marked article
CLOSED_BY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


def marked(names: str) -> bool:
    """Whether a whole name (of a class, say) is that of a menu, an advert and so on: ``ad``, ``cookie-notice``, ``share-buttons``."""
    for name in names.split():
        first, *others = [x for x in re.split("[_-]", name) if x] or [""]
        if MARK.fullmatch(first) and all(MARK.fullmatch(x) or x.lower() in PART for x in others):
            return True
        if others and others[-1].lower() in COMMENTS and first.lower() not in SAYING:  # reader-comments, post-comments
            return True
    return False


def raw_end(html: str, at: int, tag: str) -> int:
    """Where an element whose inside is not read ends."""
    depth = 1
    for m in RAW_TAG[tag].finditer(html, at):
        if m[1]:
            depth -= 1
        elif tag in NESTED and not m[0].endswith("/>"):
            depth += 1
        if not depth:
            return m.end()
    return len(html)


class Element:
    """An element: its tag path of block elements, the block element it is or stands in (``box``), and the one below root, html and
    body (``top``), and the nearest ``article``. Flags hold for what is inside too, but ``named`` (a marked name) and ``holds`` (content directly inside)."""
    __slots__ = ("tag", "up", "path", "box", "top", "article", "outside", "inside", "heading", "named", "holds")

    def __init__(self, tag: str, up: Element | None, path: int, named: bool):
        block = up is None or tag not in INLINE
        self.tag, self.up, self.path, self.named, self.holds = tag, up, path, named, False
        self.box: Element = self if block else up.box
        self.top: Element | None = up and (up.top or (self if block and tag not in ("html", "body") else None))
        self.article: Element | None = self if tag == "article" else up and up.article
        own_header = tag == "header" and up is not None and up.inside  # an article's own header has its title
        self.outside = tag in OUTSIDE and not own_header or up is not None and up.outside
        self.inside = tag in ("article", "main") or up is not None and up.inside
        self.heading = tag in HEADINGS or up is not None and up.heading


class Node:
    """A block of text, or the part of it that is outside the article, and the element it begins in."""
    __slots__ = ("element", "path", "outside", "text")

    def __init__(self, element: Element, text: str):
        self.element, self.path, self.outside, self.text = element, element.path, element.outside, text


def pieces_of(html: str) -> tuple[list[tuple[Element, int, str]], list[Element]]:
    """Text nodes in page order, each with its element and the number of its block, and all elements, outer ones first.

    Inline elements do not begin a block, and have the path of the block element around them.
    """
    paths: dict[tuple[int, str], int] = {}
    stack = [Element("", None, 0, False)]
    elements = list(stack)
    found, block, at = [], 0, 0

    def add(text: str) -> None:
        if text:
            found.append((stack[-1], block, unescape(text)))
    while m := TOKEN.search(html, at):
        closing, tag, rest = m[1], (m[2] or "").lower(), m[3] or ""
        add(html[at:m.start()])
        at = m.end()
        if not tag:
            continue
        if tag not in INLINE:
            block += 1
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            continue
        if tag in RAW:
            if not rest.endswith("/"):  # what is inside is not read as tags
                at = raw_end(html, at, tag)
            continue
        if tag in VOID or rest.endswith("/"):
            continue
        while tag in CLOSED_BY and stack[-1].box.tag in CLOSED_BY[tag]:  # also where an inline element was left open inside
            del stack[stack.index(stack[-1].box):]
        names = " ".join(x.strip("\"'") for x in NAMES.findall(rest))
        up = stack[-1]
        path = up.path if tag in INLINE else paths.setdefault((up.path, tag), len(paths) + 1)
        stack.append(Element(tag, up, path, bool(names) and tag not in UNMARKED and marked(names)))
        elements.append(stack[-1])
    add(html[at:])
    return found, elements


def forget_wrappers(found: list[tuple[Element, int, str]], elements: list[Element]) -> None:
    """Names that leave nothing say nothing: the largest of the outermost named elements loses its name until text is left."""
    near: dict[Element, Element | None] = {elements[0]: None}  # the innermost named element around, itself included
    inner: dict[Element | None, list[Element]] = {None: []}
    for e in elements[1:]:
        near[e] = near[e.up]
        if e.named:
            inner[near[e]].append(e)
            near[e], inner[e] = e, []
    own = dict.fromkeys(inner, 0)
    for e, _, text in found:
        if not e.outside:
            own[near[e]] += len(text.strip())
    size = dict(own)
    for e in reversed(elements[1:]):
        if e.named:
            size[near[e.up]] += size[e]
    heap: list[tuple[int, int, Element]] = []
    order, last = itertools.count(), None
    while not own[last]:
        for e in inner[last]:
            heappush(heap, (-size[e], next(order), e))
        if not heap:
            return
        last = heappop(heap)[2]
        last.named = False


def nodes_of(html: str) -> tuple[list[Node], list[Element]]:
    """Blocks with text, in page order, and all elements, outer ones first."""
    found, elements = pieces_of(html)
    by_tag = [e.outside for e in elements]
    around = set()  # elements around the first article are no menu, whatever their names
    e = next((e for e in elements if e.tag == "main"), None) or next((e for e in elements if e.tag == "article"), None)
    while e:
        around.add(e)
        e = e.up
    for e in elements[1:]:
        e.named = e.named and e not in around
        e.outside = e.outside or e.up.outside
    forget_wrappers(found, elements)
    for e in elements[1:]:
        e.outside = e.outside or e.up.outside or e.named
    if not any(text.strip() and not e.outside for e, _, text in found):
        for e, outside in zip(elements, by_tag):
            e.outside = outside
    blocks: dict[tuple[int, bool], tuple[Element, list[str]]] = {}
    for e, block, text in found:
        blocks.setdefault((block, e.outside), (e, []))[1].append(text)
    nodes = [Node(e, " ".join("".join(parts).split())) for e, parts in blocks.values()]
    return [n for n in nodes if n.text], elements


def ratios(nodes: list[Node]) -> np.ndarray:
    """Fused, smoothed ratio of each block."""
    sizes = np.array([len(n.text) for n in nodes], float)
    marks = np.array([len(PUNCTUATION.findall(n.text)) for n in nodes], float)
    path = np.array([n.path for n in nodes])
    total, punctuation, count = (np.bincount(path, w) for w in (sizes, marks, sizes > 0))
    count = np.maximum(count, 1)
    weight = np.array([0 if n.outside else WEIGHT if n.element.inside else 1 for n in nodes])
    fused = ((total / count) * (1 + np.log1p(punctuation / count)))[path] * weight
    padded = np.concatenate([fused[:1], fused, fused[-1:]])
    return np.sqrt(fused * (0.25 * padded[:-2] + 0.5 * fused + 0.25 * padded[2:]))


def chosen(nodes: list[Node], elements: list[Element], ratio: np.ndarray) -> list[bool]:
    """Content: blocks over the share of the mean ratio, then short blocks by the content next to them.

    A block under the share is content in an element that holds a block over it directly and in the nearest ``article`` around
    one, but not in another ``article`` inside these; between two blocks over the share of one element of the body; and, for
    headings, before content. Blocks outside never are.
    """
    good = [i for i, n in enumerate(nodes) if not n.outside and ratio[i] > 0]
    least = SHARE * ratio[good].mean() if good else 0
    strong = [i for i in good if ratio[i] > least]
    keep = [False] * len(nodes)
    for i in strong:
        box = nodes[i].element.box
        for holder in (box, box.up.box if box.up else box, box.article):
            if holder and holder.top:
                holder.holds = True
    for e in elements[1:]:
        e.holds = e.holds or e.up.holds and e.tag != "article"
    for i in good:
        keep[i] = ratio[i] > least or nodes[i].element.holds
    for a, b in zip(strong, strong[1:]):
        x, y = nodes[a].element, nodes[b].element
        if x.top is y.top or all(e.top is None or e.top is e.box for e in (x, y)):  # in one element, or both directly in the body
            for i in range(a + 1, b):
                keep[i] = not nodes[i].outside
    after = False
    for i in reversed(good):
        after = keep[i] = keep[i] or (after and nodes[i].element.heading)
    return keep


def main_text(html: str | None) -> str:
    """Text of the content blocks: white space within a block is one space, blocks are joined by one space."""
    nodes, elements = nodes_of(html) if html else ([], [])
    if not nodes:
        return ""
    keep = chosen(nodes, elements, ratios(nodes))
    return " ".join(n.text for n, good in zip(nodes, keep) if good)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in words.slices(batch, "html"):
            texts = [main_text(x) for x in some["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([some["page_id"], some["url"], pa.array(texts, pa.string()),
                                              pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points of the text).

    A null, empty or text-free page has an empty text. Rows are handled each for itself; other columns are not looked at.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
