"""Main text of web pages by composite text density.

Each page becomes a small DOM. For every node the composite density is its characters per tag,
adjusted by its own and the body's share of link text; a node's density sum adds the densities of
its children and of its own text. Evidence bends the densities and never decides alone: elements,
roles and names that mark menus, page headers, footers, side bars, notices, adverts, forms and
reader comments make their text count as link text (so their density falls to zero), unless the
marked part is far larger than the rest of the page; inside ``article`` and ``main`` sums count
double. The node with the largest sum holds the article. The least density on its path from the
body is the threshold: beside the path, up to an enclosing ``article`` or ``main``, parts at or
above the threshold and headings belong to the article too. In what is chosen, marked parts whose
density lies below the threshold are left out; all else is kept.

Text is decoded, white space inside a block becomes one space, blocks are joined in page order by a
blank line. Everything is linear in the page: open elements are found by name and scope, not by
walking the stack. Defined cases: null, empty or text-free html gives the empty text, as does a page
of nothing but marked parts; broken nesting is repaired as browsers do for paragraphs, list items
and cells; unknown tags are inline; cut tags are text-free; repeated rows stay; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<(?:!--.*?(?:-->|\Z)|![^>]*(?:>|\Z)|\?[^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z))", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+")

# Element names of HTML, by how they lay out or what they hold.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "canvas", "audio", "video"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements whose content is no running text of the article.
MARKED = {"nav", "footer", "aside", "form", "button", "select", "option", "label", "dialog", "menu", "head"}
ARTICLE = {"article", "main"}
BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form"}
# Words of class and id names that mark what is not the article, and words that say nothing beside them.
BAD_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "notifications", "alert", "disclaimer",
    "sidebar", "aside", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "masthead", "topbar", "toolbar",
    "footer", "comment", "comments", "commentlist", "disqus", "replies", "respond", "thread", "share", "sharing", "social", "related", "recommended",
    "newsletter", "subscribe", "subscription", "signup", "login", "search", "popup", "modal", "overlay", "pagination", "pager", "widget", "widgets", "hidden",
}
NEUTRAL_WORDS = {
    "area", "bar", "block", "body", "bottom", "box", "buttons", "col", "column", "container", "content", "form", "group", "holder", "inner", "item", "items", "js", "left", "links", "list", "main",
    "outer", "page", "panel", "post", "posts", "right", "row", "section", "site", "slot", "small", "large", "the", "top", "unit", "user", "reader", "wrap", "wrapper", "zone", "",
}
#: Marked parts may hold this many characters, or so many times the text that isn't marked; larger ones aren't believed.
MARKED_CHARS, MARKED_TIMES = 1500, 3
INSIDE = 2.0


class _Node:
    __slots__ = ("tag", "parent", "own", "chars", "tags", "link_chars", "link_tags", "kids", "hidden", "marked", "link", "inside", "scope", "density", "sum")

    def __init__(self, tag: str, parent: "_Node | None", hidden: bool, marked: bool, link: bool, inside: bool, scope: tuple):
        self.tag, self.parent, self.hidden, self.marked, self.link, self.inside, self.scope = tag, parent, hidden, marked, link, inside, scope
        self.own = self.chars = self.link_chars = self.link_tags = 0
        self.tags, self.kids, self.density, self.sum = 0, [], 0.0, 0.0


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(text)} if text and not text.isspace() else {}


def _hidden(attrs: dict[str, str]) -> bool:
    return bool(attrs) and ("hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower())


def _bad_name(name: str, inside: bool) -> bool:
    """A name all of whose words are bad or say nothing; ``social-history`` has a word of its own."""
    words = _SPLIT.split(name)
    bad = {w for w in words if w in BAD_WORDS or w == "header" and not inside}
    return bool(bad) and all(w in bad or w in NEUTRAL_WORDS or w.isdigit() for w in words)


def _is_marked(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    """Evidence that an element is not part of the article."""
    if tag in MARKED or tag == "header" and not inside:
        return True
    if not attrs or tag in ("html", "body") or tag in ARTICLE:
        return False
    if attrs.get("role", "").lower() in BAD_ROLES:
        return True
    return any(_bad_name(n, inside) for n in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split())


#: Start tags that close an open element: (tags, what they close, what stops them).
_CLOSES = (
    ({"li"}, {"li"}, {"ul", "ol", "menu"}),
    ({"dt", "dd"}, {"dt", "dd"}, {"dl"}),
    ({"tr"}, {"tr"}, {"table"}),
    ({"td", "th"}, {"td", "th"}, {"tr", "table"}),
    ({"option"}, {"option"}, {"select"}),
    (BLOCK, {"p"}, (BLOCK - {"p"}) | {"td", "th"}),
)
_SCOPED = {t for _, ends, stops in _CLOSES for t in ends | stops}
_GROUP = {t: tuple(g for g, (tags, _, _) in enumerate(_CLOSES) if t in tags) for tags, _, _ in _CLOSES for t in tags}
_CELLS = {"td", "th", "table"}
_OUT_OF_CELLS = {"table", "tr", "tbody", "article", "main", "body", "html", "div", "section"}
#: Nearest open element of each group of _CLOSES, and the nearest cell or table: places in the stack, or -1.
_NO_SCOPE = (-1,) * (len(_CLOSES) + 1)


def _scope(tag: str, at: int, above: tuple) -> tuple:
    if tag not in _SCOPED:
        return above
    near = [at if tag in ends else -1 if tag in stops else above[g] for g, (_, ends, stops) in enumerate(_CLOSES)]
    return (*near, at if tag in _CELLS else above[-1])


def _tree(html: str) -> tuple[_Node, list[tuple[_Node, str]]]:
    """The DOM and the blocks of text: (node, text) in page order."""
    root = _Node("html", None, False, False, False, False, _NO_SCOPE)
    stack, blocks, text = [root], [], []
    open_: dict[str, list[int]] = {}  # places in the stack of each open tag

    def flush() -> None:
        if text:
            line = " ".join(unescape("".join(text)).split())
            if line:
                blocks.append((stack[-1], line))
            text.clear()

    def close(k: int) -> None:
        if any(n.tag in BLOCK for n in stack[k:]):
            flush()
        for n in stack[k:]:
            open_[n.tag].pop()
        del stack[k:]

    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            lt = size
        top = stack[-1]
        if lt > at and not top.hidden:
            piece = html[at:lt]
            text.append(piece)
            top.own += len(piece) if piece.isascii() and "&" not in piece else len(unescape(piece))
        if lt == size:
            break
        m = _TOKEN.match(html, lt) or _LOOSE.match(html, lt)
        if not m:
            if not top.hidden:
                text.append("<")
                top.own += 1
            at = lt + 1
            continue
        at = m.end()
        if m.lastindex is None or m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            places = open_.get(tag)
            if places and (tag in _OUT_OF_CELLS or places[-1] >= stack[-1].scope[-1]):
                close(places[-1])
            continue
        if tag == "html":
            continue
        if tag in BLOCK:
            flush()
        for g in _GROUP.get(tag, ()):
            if (k := stack[-1].scope[g]) >= 0:
                close(k)
        top = stack[-1]
        top.tags += 1
        if top.marked or top.link:
            top.link_tags += 1
        if tag == "br" or tag in ("td", "th"):
            text.append(" ")
        if tag in VOID:
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else size
            continue
        attrs = _attributes(m[3])
        node = _Node(tag, top, top.hidden or _hidden(attrs), top.marked or _is_marked(tag, attrs, top.inside), top.link or tag == "a", top.inside or tag in ARTICLE, _scope(tag, len(stack), top.scope))
        if tag == "a" and not (top.marked or top.link):
            node.link_tags += 1
        if not node.hidden:
            top.kids.append(node)
        if tag in BLOCK or node.marked and not top.marked:
            flush()
        open_.setdefault(tag, []).append(len(stack))
        stack.append(node)
    flush()
    return root, [(n, t) for n, t in blocks if not n.hidden]


def _measure(root: _Node) -> list[_Node]:
    """All kept nodes, parents first, with totals, densities and density sums."""
    order = [root]
    for n in order:
        order += n.kids
    believe = _believed(order)
    for n in order:
        n.marked = n.marked and believe
        n.chars = n.own
        n.link_chars = n.own if n.marked or n.link else 0
        if n.marked:
            n.link_tags = n.tags
    for n in reversed(order):
        for k in n.kids:
            n.chars += k.chars
            n.tags += k.tags
            n.link_chars += k.link_chars
            n.link_tags += k.link_tags
    share = root.link_chars / root.chars if root.chars else 0.0
    for n in order:
        n.density = _density(n, share)
    for n in order:
        # A node's own text counts like a child with its share of the node's density.
        n.sum = (sum(k.density for k in n.kids) + (n.density * n.own / n.chars if n.own else 0.0)) * (INSIDE if n.inside else 1.0)
    return order


def _believed(order: list[_Node]) -> bool:
    """Whether the marks fit the sizes: what is marked is not far larger than what isn't."""
    marked = sum(n.own for n in order if n.marked)
    return marked <= max(MARKED_CHARS, MARKED_TIMES * (sum(n.own for n in order) - marked))


def _density(n: _Node, share: float) -> float:
    """Composite text density: characters per tag, by how little of them is link text."""
    if not n.chars:
        return 0.0
    tags, links, link_tags = max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
    plain = max(1, n.chars - n.link_chars)
    base = math.log(n.chars * n.link_chars / plain + share * n.chars + math.e)
    ratio = n.chars / links * tags / link_tags
    return n.chars / tags * math.log(max(ratio, 1.0)) / math.log(max(base, math.e))


def main_text(html: str | None) -> str:
    """The article's text; empty if the page has none."""
    if not html:
        return ""
    root, blocks = _tree(html)
    if not blocks:
        return ""
    order = _measure(root)
    best = root
    for n in order:  # of equal sums the innermost
        if n.sum >= best.sum:
            best = n
    if best.sum <= 0:
        return ""
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    least = min(n.density for n in path)
    chosen, on_path = {best}, set(path)
    for n in path:
        if n.tag in ARTICLE:
            chosen.add(n)
            break
        # Beside the path: dense parts and headings.
        chosen.update(k for k in n.kids if k not in on_path and not k.marked and (k.density >= least or k.tag in HEADINGS))
    loose = set(path[: path.index(n) + 1])  # text directly in a node of the path
    kept = {root: root in chosen}
    for n in order[1:]:
        kept[n] = (kept[n.parent] or n in chosen) and not (n.marked and n.density < least)
    return "\n\n".join(t for n, t in blocks if kept[n] or n in loose and not n.marked)


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kept = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return kept.mapInArrow(run, f"page_id {kept.schema['page_id'].dataType.simpleString()}, url {kept.schema['url'].dataType.simpleString()}, text string, n_chars long")
