"""Main text of web pages by composite text density.

Each page becomes a small tree. Navigation, headers, footers, asides, forms, notices, adverts, comments and code are cut
from it. What is only known by its class or id, and forms, stay where they are layout around the content: where they hold
a ``main`` element, all the page's articles and first headings, or more than half of its text outside links; comments
only where no article or first heading lies beside or around them. For every node left, the density is its characters per tag, lowered where much of the text is in links; a
node's density sum is the sum over its children. The node with the largest sum is the core of the article. The smallest
density on the path from it to the body is the threshold: beside the path, subtrees at or above it belong to the article
too, others do not. Texts directly inside the elements of the path are judged the same way, together with the inline
elements among them. One rule by tags adds to this: the outermost ``article`` around the core, or else the outermost
``main``, belongs to the article with all it holds.

Defined results: a null or empty page, or one without body text, gives the empty string; broken mark-up (unclosed or
stray tags, pages cut off in the middle of a tag) is closed the way browsers do; text without any tag is one block;
repeated rows each get a row; an empty table gives no rows; other columns are ignored. Memory is that of a single page.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)"
                  r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir",
          "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
          "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary",
          "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_CUT = {"head", "nav", "header", "footer", "aside", "script", "style", "noscript", "template", "button",
        "select", "textarea", "iframe", "svg", "canvas", "object", "dialog", "menu", "title", "input", "option",
        "audio", "video", "map", "xmp"}
_CUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert",
              "menu", "menubar", "toolbar"}
_CUT_NAMES = {
    "ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo",
    "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay",
    "newsletter", "subscribe", "subscription", "signup", "sidebar", "menu", "navbar", "nav", "navigation", "breadcrumb",
    "breadcrumbs", "header", "masthead", "topbar", "footer", "comment", "comments", "commentlist", "disqus", "respond",
    "reply", "replies", "share", "sharing", "social", "related", "recommended", "recommendations", "widget", "toolbar",
    "login", "search", "pagination", "pager", "copyright", "disclaimer", "alert", "hidden"}
_COMMENTS = {"comment", "comments", "commentlist", "disqus", "respond", "reply", "replies"}
# Cut whatever it holds, cut unless it is layout, comments.
_SURE, _NAMED, _TALK = 1, 2, 3
# Start tag -> open elements it closes, looked for up to the given boundaries.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
           "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
_P_SCOPE = {"button", "table", "td", "th", "caption", "object"}


class _Node:
    __slots__ = ("tag", "cut", "parent", "parts", "open_p", "chars", "tags", "link_chars", "link_tags", "density", "inline")

    def __init__(self, tag, cut=0, parent=None):
        self.tag, self.cut, self.parent, self.parts = tag, cut, parent, []
        # The paragraph that a block inside this element would close.
        self.open_p = self if tag == "p" else None if parent is None or tag in _P_SCOPE else parent.open_p
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0
        # Neither a block nor around one.
        self.inline = tag not in _BLOCK


def _cut_of(tag: str, attributes: str) -> int:
    if tag in _CUT:
        return _SURE
    cut = _NAMED if tag == "form" else 0
    if not attributes or tag in ("html", "body", "main"):
        return cut
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return _SURE
        if name == "role" and value in _CUT_ROLES:
            return _SURE
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return _SURE
        if name in ("class", "id"):
            found = _CUT_NAMES.intersection(re.split(r"[^a-z]+", value))
            if found and (tag != "article" or found & {"comment", "comments", "reply"}):
                cut = max(cut, _TALK if found & _COMMENTS else _NAMED)
    return cut


def _tree(page: str) -> _Node:
    """The page as nodes; ``parts`` hold texts and child nodes in order."""
    root = top = _Node("body")
    at = 0
    # The open elements by tag, with their depth, and the depths of the open blocks: an end tag finds its element at once.
    opened, blocks, depth = {}, [0], 0

    def rise(stop):
        """Close the elements up to ``stop``, which stays open."""
        nonlocal top, depth
        while top is not stop:
            opened[top.tag].pop()
            if top.tag in _BLOCK:
                blocks.pop()
            top, depth = top.parent, depth - 1

    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            top.parts.append(page[at:m.start()])
        at = m.end()
        slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            # The end of an inline element does not close blocks around it.
            found = opened.get(tag)
            if found and (tag in _BLOCK or found[-1][0] > blocks[-1]):
                rise(found[-1][1].parent)
            continue
        if tag in ("html", "body"):
            # Attributes do not matter; a head left open ends here.
            while top is not root and tag == "body" and top.tag == "head":
                rise(top.parent)
            continue
        if tag in _BLOCK:
            if top.open_p is not None:
                rise(top.open_p.parent)
        if tag in _CLOSES:
            closed, stop = _CLOSES[tag]
            node = top
            while node is not root and node.tag not in closed and node.tag not in stop:
                node = node.parent
            if node is not root and node.tag in closed:
                rise(node.parent)
        node = _Node(tag, _cut_of(tag, attributes), top)
        top.parts.append(node)
        if tag in _VOID or attributes.endswith("/") and tag not in _BLOCK:
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            node.parts.append(page[at:end.start() if end else len(page)])
            at = end.end() if end else len(page)
            continue
        top, depth = node, depth + 1
        opened.setdefault(tag, []).append((depth, node))
        if tag in _BLOCK:
            blocks.append(depth)
    if at < len(page):
        top.parts.append(page[at:])
    return root


def _spare_layout(root: _Node) -> None:
    """Take back cuts by name of elements that hold the content."""
    order = [root]
    for node in order:
        order.extend(x for x in node.parts if isinstance(x, _Node) and x.cut != _SURE)
    if not any(n.cut for n in order):
        return
    # Per subtree: characters outside links, articles and first headings, main elements; those of comments do not count.
    text, marks, mains = {}, {}, {}
    for n in reversed(order):
        inner = [x for x in n.parts if isinstance(x, _Node) and x.cut != _SURE]
        own = sum(len("".join(html.unescape(x).split())) for x in n.parts if isinstance(x, str))
        text[id(n)] = 0 if n.tag == "a" else own + sum(text[id(x)] for x in inner)
        marks[id(n)] = (n.tag in ("article", "h1") and n.cut != _TALK) + sum(marks[id(x)] for x in inner)
        mains[id(n)] = (n.tag == "main") + sum(mains[id(x)] for x in inner)
    # Articles around each node.
    around = {id(root): 0}
    for n in order:
        if n is not root:
            around[id(n)] = around[id(n.parent)] + (n.parent.tag == "article" and n.parent.cut != _TALK)
        if not n.cut:
            continue
        most = text[id(n)] * 2 > text[id(root)]
        beside = marks[id(root)] - marks[id(n)] - around[id(n)]
        if n.cut == _TALK:
            keep = not beside and not around[id(n)] and (mains[id(n)] or marks[id(n)] or most)
        else:
            keep = mains[id(n)] or most or marks[id(n)] and not beside
        if keep:
            n.cut = 0


def _walk(root: _Node) -> list[_Node]:
    """Nodes that are not cut, parents before children."""
    order = [root]
    for node in order:
        order.extend(x for x in node.parts if isinstance(x, _Node) and not x.cut)
    return order


def _measure(order: list[_Node]) -> None:
    for node in reversed(order):
        own = sum(len("".join(html.unescape(x).split())) for x in node.parts if isinstance(x, str))
        node.chars += own
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        if node.parent is not None:
            p = node.parent
            p.chars += node.chars
            p.tags += node.tags + 1
            p.link_chars += node.link_chars
            p.link_tags += node.link_tags
            p.inline &= node.inline
    for n in order:
        _rate(n, order[0])


def _rate(n: _Node, body: _Node) -> None:
    if n.chars:
        share = body.link_chars / max(1, body.chars)
        base = math.log(n.chars / max(1, n.chars - n.link_chars) * n.link_chars + share * n.chars + math.e)
        ratio = n.chars / max(1, n.link_chars) * max(1, n.tags) / max(1, n.link_tags)
        n.density = max(0.0, n.chars / max(1, n.tags) * math.log(max(ratio, 1.0)) / math.log(max(base, math.e)))


def _runs(n: _Node) -> list[_Node]:
    """The parts of a node that are not cut; neighbouring texts and inline elements share one node of their own."""
    out, run = [], None
    for x in n.parts:
        if isinstance(x, _Node) and x.cut:
            continue
        if isinstance(x, _Node) and not x.inline:
            out.append(x)
            run = None
            continue
        if run is None:
            run = _Node("", parent=n)
            out.append(run)
        run.parts.append(x)
        if isinstance(x, str):
            run.chars += len("".join(html.unescape(x).split()))
        else:
            run.chars += x.chars
            run.tags += x.tags + 1
            run.link_chars += x.link_chars
            run.link_tags += x.link_tags
    return out


def _article(order: list[_Node]) -> list[_Node]:
    """The subtrees that make up the article, in page order."""
    def total(n):
        return sum(x.density for x in n.parts if isinstance(x, _Node) and not x.cut)

    body = order[0]
    core = max(order, key=total)
    if total(core) <= 0:
        return [body]
    path, node = [], core
    while node is not None:
        path.append(node)
        node = node.parent
    threshold = min(n.density for n in path)
    around = [i for i, n in enumerate(path) if n.tag == "article"] or [i for i, n in enumerate(path) if n.tag == "main"]
    if around:
        path = path[around[-1]:]
        core = path[0]
    chosen, on_path = [], set(map(id, path))

    def belongs(x):
        if x.tag:
            return id(x) in on_path or x.chars and x.density >= threshold
        # The path may end inside a line of text.
        _rate(x, body)
        return x.chars and x.density >= threshold or any(id(y) in on_path for y in x.parts)

    stack = [body]
    while stack:
        n = stack.pop()
        if n is core or id(n) not in on_path:
            chosen.append(n)
            continue
        stack.extend(x for x in reversed(_runs(n)) if belongs(x))
    return chosen


def _blocks(nodes: list[_Node]) -> list[str]:
    blocks, line = [], []

    def flush():
        text = " ".join(html.unescape("".join(line)).split())
        if text:
            blocks.append(text)
        line.clear()

    # A stack, since pages may nest deeper than Python recurses; None ends a block.
    for node in nodes:
        stack = [node]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                line.append(x)
            elif not x.cut:
                if x.tag in _BLOCK:
                    flush()
                    stack.append(None)
                elif x.tag == "br":
                    line.append(" ")
                stack.extend(reversed(x.parts))
        flush()
    return blocks


def main_text(page: str | None) -> str:
    """The article of one page, a line per block."""
    if not page:
        return ""
    root = _tree(page)
    _spare_layout(root)
    order = _walk(root)
    _measure(order)
    return "\n".join(_blocks(_article(order)))


def _extract(batches):
    for batch in W.slices(batches, "html"):
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_pydict({
            "page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()),
            "n_chars": pa.array([len(t) for t in texts], pa.int64())})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its length in code points, one row per page; no shuffle."""
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(
        _extract, f"page_id {kind}, url string, text string, n_chars long")
