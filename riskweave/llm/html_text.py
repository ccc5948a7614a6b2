"""Main text of web pages by composite text density.

A page is parsed to a tree with the usual repairs (implied end tags, void elements, raw text of script and style; as in
browsers, elements nested deeper than DEPTH stand beside each other, and an unclosed tag ends at the next `>`).
Elements that are never article text are left out: scripts, styles, forms, menus, page headers and footers, asides, and
those with a class or id that is made of nothing but the names of adverts, notices, sidebars, menus, reader comments and
words of layout.  For each other node the density is its characters per tag, damped by its share of link text:

    base    = log(C/Nc * Lc + Lc_body/C_body * C + e)
    density = C/T * log(C/Lc * T/Lt) / max(1, 1 + log(base)) + C/T / 100

with C characters, T tags, Lc and Lt those inside links and Nc = C - Lc, each at least 1 as a divisor, and the first
logarithm at least 0.  The node with the largest sum of its children's densities, direct text being a child, is the main
one; the least density on the path from it to the body is the threshold.  Every node on or above the threshold is main
text as a whole, and so are those around a direct text on or above it and the page's h1; beside the main node, groups of
links alone are menus.  If the main node lies in an article or main element, marked nodes in such elements mark these,
so that short headings and paragraphs stay, and others are left out.

Blocks are trimmed, white space inside a block becomes one blank, blocks are joined by one line feed in page order.
Null or empty html, and pages without text, give an empty text; null url and page_id are allowed; nothing is capped.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element classes.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg canvas select object audio video".split())
NEVER = frozenset("head script style nav footer aside form button select option textarea input iframe noscript template svg canvas object audio video dialog menu title noframes noembed xmp label fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br nobr math semantics mrow mi mn mo ms mtext msub msup msubsup mfrac msqrt mroot munder mover munderover mstyle mspace".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th", "tbody"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
NAMES = frozenset("ad ads advert advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar side rail widget menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar footer masthead topbar comment comments comentarios kommentare disqus respond replies reply discussion share sharing social related recommended recommendations login search skip legal copyright tags".split())
LAYOUT = frozenset("area banner bar block body bottom box button buttons cell center col column container content e fixed float footer group header head inner inline item items js label large left link links list main middle mobile module outer page panel post primary right row secondary section site slot small text top unit wrap wrapper zone".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())

DEPTH = 500

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"[^\"'>]*")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?=[\s=/]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I | re.S)
_STYLE_HIDDEN = re.compile(r"style\s*=\s*[\"'][^\"']*display\s*:\s*none", re.I)
_PART = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "never", "chars", "tags", "link_chars", "link_tags", "density", "direct", "total", "marked", "named")

    def __init__(self, tag: str, parent: Node | None, never: bool = False, named: bool = False):
        self.tag, self.parent, self.never, self.named = tag, parent, never, named
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.direct = self.total = 0.0
        self.marked = False


def _is_box(name: str) -> bool:
    """Whether a class or id names a box beside the text: each part does, or is a word of layout."""
    parts = _PART.findall(name)
    return any(x in NAMES for x in parts) and all(x in NAMES or x in LAYOUT for x in parts)


def _excluded(tag: str, attributes: str, above: Node) -> tuple[bool, bool]:
    """Whether the element is never article text; whether only its names say so."""
    if tag in NEVER:
        return True, False
    if tag == "header":
        while above:
            if above.tag in ("article", "main"):
                break
            above = above.parent
        else:
            return True, False
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = "".join(values).strip().lower(), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return True, False
        if name in ("class", "id") and any(_is_box(x) for x in value.split()):
            return True, True
    return bool(_STYLE_HIDDEN.search(attributes)), False


class _Reader:
    """Markup, piece by piece: (kind, tag or text, attributes).  Every character is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.at = page, 0
        self.last = {c: page.rfind(c) for c in ('"', "'", ">", "-->", "]]>")}
        self.quoted = True  # whether tags are still read with their quotes
        self.unclosed: set[str] = set()

    def tag_end(self, at: int) -> int:
        """The place of the > that ends the tag, or -1."""
        page, start = self.page, at
        if self.last[">"] < at:
            return -1
        while self.quoted:
            at = _PLAIN.match(page, at).end()
            if at >= len(page):
                self.quoted = False  # no tag's end was found this way, nor would be from here on
                break
            if page[at] == ">":
                return at
            close = page.find(page[at], at + 1) if self.last[page[at]] > at else -1
            at = at + 1 if close < 0 else close + 1
        return page.find(">", start)

    def pieces(self) -> Iterator[tuple[str, str, str]]:
        page, n = self.page, len(self.page)
        while self.at < n:
            at = page.find("<", self.at)
            while 0 <= at < n - 1 and not (page[at + 1] in "!?" or page[at + 1] == "/" and page[at + 2: at + 3].isalpha() or page[at + 1].isascii() and page[at + 1].isalpha()):
                at = page.find("<", at + 1)
            if at < 0 or at >= n - 1:
                yield "text", page[self.at:], ""
                return
            if at > self.at:
                yield "text", page[self.at: at], ""
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4) if self.last["-->"] >= at + 4 else -1
                self.at = n if end < 0 else end + 3
            elif page.startswith("<![CDATA[", at) and self.last["]]>"] > at:
                end = page.find("]]>", at)
                yield "text", page[at + 9: end], "raw"
                self.at = end + 3
            elif page[at + 1] in "!?/":
                end = page.find(">", at) if self.last[">"] > at else -1
                name = _NAME.match(page, at + 2) if page[at + 1] == "/" else None
                self.at = n if end < 0 else end + 1
                if name and end >= 0:
                    yield "end", name[0].lower(), ""
            else:
                name = _NAME.match(page, at + 1)
                end = self.tag_end(name.end())
                if end < 0:  # the rest of the page is inside the tag
                    self.at = n
                    return
                self.at = end + 1
                yield "start", name[0].lower(), page[name.end(): end]

    def skip(self, tag: str) -> bool:
        """Go behind the end tag, if there is one."""
        if tag in self.unclosed:
            return False
        end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(self.page, self.at)
        close = self.page.find(">", end.end()) if end else -1
        if close < 0:
            self.unclosed.add(tag)
            return False
        self.at = close + 1
        return True


def parse(page: str) -> Node:
    root = Node("#root", None)
    now, depth, reader = root, 0, _Reader(page)
    for kind, tag, attributes in reader.pieces():
        if kind == "text":
            now.children.append(entities.unescape(tag) if attributes != "raw" else tag)
        elif kind == "end":
            up, levels = now, 0
            while up is not root and up.tag != tag:
                if up.tag in ("table", "article", "body") and (tag in INLINE or tag in ("p", "li")):
                    up = root
                    break
                up, levels = up.parent, levels + 1
            if up is not root:
                now, depth = up.parent, depth - levels - 1
            elif tag in ("p", "br"):
                now.children.append(Node(tag, now))
        else:
            if tag in ("html", "body"):
                while now is not root and now.tag != "html":
                    now, depth = now.parent, depth - 1
            elif tag in CLOSES_P:
                up, levels = now, 0
                while up is not root and (up.tag in INLINE or up.tag == "p"):
                    if up.tag == "p":
                        now, depth = up.parent, depth - levels - 1
                        break
                    up, levels = up.parent, levels + 1
            if tag in CLOSES:
                up, close = now, None
                while up is not root and up.tag not in SCOPE[tag]:
                    if up.tag in CLOSES[tag]:
                        close = up
                    up = up.parent
                while close is not None and now is not close.parent:
                    now, depth = now.parent, depth - 1
            node = Node(tag, now, *_excluded(tag, attributes, now))
            now.children.append(node)
            if tag in RAW and not attributes.rstrip().endswith("/"):
                if not reader.skip(tag) and tag in ("script", "style"):  # of other unclosed raw text only the tag goes
                    break
            elif tag not in VOID and not attributes.rstrip().endswith("/") and depth < DEPTH:
                now, depth = node, depth + 1
    return root


def _acquit(root: Node) -> None:
    """An element that only its names exclude stays if it holds an article, or the page's heading and most of its text."""
    every, todo = [], [root]
    while todo:
        x = todo.pop()
        every.append(x)
        todo += [c for c in x.children if isinstance(c, Node) and (not c.never or c.named)]
    inside: dict[int, tuple[int, bool, bool]] = {}
    for x in reversed(every):  # children before parents
        chars = sum(len(c) for c in x.children if isinstance(c, str))
        of = [(c, inside[id(c)]) for c in x.children if isinstance(c, Node) and id(c) in inside]
        inside[id(x)] = (chars + sum(i[0] for _, i in of), any(i[1] or c.tag in ("article", "main") for c, i in of), any(i[2] or c.tag == "h1" for c, i in of))
    total = inside[id(root)][0]
    for x in every:
        if x.named:
            chars, article, heading = inside[id(x)]
            x.never = not (article or heading and chars > 0.6 * total)


def _order(root: Node) -> list[Node]:
    """Parents before children."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += [c for c in reversed(x.children) if isinstance(c, Node) and not c.never]
    return out


def _measure(order: list[Node]) -> None:
    for x in reversed(order):
        for c in x.children:
            if isinstance(c, str):
                x.chars += len("".join(c.split()))
            elif not c.never:
                x.chars += c.chars
                x.tags += c.tags + 1
                x.link_chars += c.link_chars
                x.link_tags += c.link_tags + (c.tag == "a")
        if x.tag == "a":
            x.link_chars, x.link_tags = x.chars, x.tags
    body = next((x for x in order if x.tag == "body"), order[0])
    share = body.link_chars / body.chars if body.chars else 0.0

    def density(chars: int, tags: int, link_chars: int, link_tags: int) -> float:
        tags, links, link_tags = max(1, tags), max(1, link_chars), max(1, link_tags)
        base = math.log(chars / max(1, chars - link_chars) * link_chars + share * chars + math.e)
        return max(0.0, chars / tags * math.log(max(1.0, chars / links * tags / link_tags)) / max(1.0, math.log(base) + 1.0)) + chars / tags * 0.01

    for x in reversed(order):
        if x.chars:
            x.density = density(x.chars, x.tags, x.link_chars, x.link_tags)
            own = sum(len("".join(c.split())) for c in x.children if isinstance(c, str))
            if own:
                x.direct = density(own, 1, own if x.tag == "a" else 0, x.tag == "a")
        x.total = x.direct + sum(c.density for c in x.children if isinstance(c, Node) and not c.never)


def _main(order: list[Node]) -> list[Node]:
    top = max(order, key=lambda x: x.total)
    if not top.total:
        return [next((x for x in order if x.tag == "body"), order[0])]
    threshold, x = top.density, top
    while x and x.tag not in ("body", "#root"):
        threshold = min(threshold, x.density)
        x = x.parent
    out = [top] + [x for x in order if x is not top and x.tag not in INLINE and (x.density >= threshold or x.direct >= threshold or x.tag == "h1")]
    promoted, holds = [], False
    for x in out:
        while x is top and top.tag in INLINE | {"p"} or x.tag in INLINE:
            top = x = x.parent
        up, of = x, None
        while up:
            if up.tag in ("article", "main"):
                of = up
            up = up.parent
        promoted.append(of or x)
        holds = holds or of is not None and len(promoted) == 1
    if holds:  # the main node lies in an article, which says where the text ends
        return [x for x in promoted if x.tag in ("article", "main")]
    promoted = [top, *out[1:]]
    above, x = set(), top.parent
    while x:
        above.add(id(x))
        x = x.parent
    for x in order:  # groups of links beside the main node
        if id(x.parent) in above and x is not top and id(x) not in above and x.tag not in INLINE and x.link_tags > 1 and x.chars - x.link_chars <= x.link_tags:
            x.never = True
    return promoted


def _blocks(marked: list[Node], root: Node) -> list[str]:
    for x in marked:
        x.marked = True
    out: list[str] = []
    now: list[str] = []

    def end() -> None:
        text = _SPACE.sub(" ", "".join(now)).strip()
        if text:
            out.append(text)
        now.clear()

    todo: list = [(root, False)]
    while todo:
        x, inside = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            if inside:
                now.append(x)
        elif not x.never:
            inside = inside or x.marked
            if x.tag == "br":
                now.append(" ")
            elif x.tag not in INLINE:
                end()
                todo.append((None, False))
            todo += [(c, inside) for c in reversed(x.children)]
    end()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    _acquit(root)
    order = _order(root)
    _measure(order)
    return "\n".join(_blocks(_main(order), root))


def extract(pages: DataFrame, key: tuple = ("page_id", "url"), html: str = "html") -> DataFrame:
    """pages -> the key columns, text and n_chars."""
    kept = pages.select(*key, F.col(html).cast("string").alias("_html"))
    schema = kept.drop("_html").schema.add("text", "string").add("n_chars", "long")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [main_text(x) for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=[*part.schema.names[:-1], "text", "n_chars"])

    return kept.mapInArrow(texts, schema)
