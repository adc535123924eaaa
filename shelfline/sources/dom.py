"""A small document tree with the selectors that product pages need: tags,
``*``, ``#id``, ``.class``, ``[attr]``, ``[attr="v"]``, ``[attr*="v"]``,
descendants and comma lists.

Nodes are numbered in document order and know the last number and the stretch
of the page's text below them, so texts and selections are slices, and nothing
here recurses: pages may be nested as deeply as they like."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Opening one of these closes an open paragraph.
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_PART = re.compile(r'([\w-]+|\*)|#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:(\*?)="([^"]*)")?\]')


class Node:
    __slots__ = ("page", "order", "end", "tag", "attrs", "classes", "parent", "kids", "under", "first", "last", "opened", "closed")

    def __init__(self, page: Page, order: int, tag: str, attrs: dict[str, str], parent: Node | None, first: int):
        self.page, self.order, self.end, self.tag, self.attrs, self.parent = page, order, order, tag, attrs, parent
        self.classes, self.kids, self.first, self.last = attrs.get("class", "").split(), 0, first, first
        #: Line, column and length of its start tag; line and column of what closes it.
        self.opened, self.closed = (1, 0, 0), None
        #: Whether a second-level heading is around it.
        self.under = parent is not None and (parent.under or parent.tag == "h2")

    def text(self) -> str:
        return self.page.text[self.first : self.last]

    def source(self) -> str:
        """What the page has between its tags, as it is written."""
        line, column, length = self.opened
        return self.page.html[self.page.place(line, column) + length : self.page.place(*self.closed) if self.closed else None]

    def above(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def wider(self) -> Iterator[Node]:
        """The elements around it with more text, the nearest first; of those
        with one text the innermost."""
        span = (self.first, self.last)
        for node in self.above():
            if (node.first, node.last) != span:
                span = (node.first, node.last)
                yield node

    def select(self, selector: str) -> list[Node]:
        """The elements below that a selector names, in document order."""
        found, orders = self.page.matches(selector)
        return found and found[bisect_right(orders, self.order) : bisect_right(orders, self.end)]


class Page:
    """A page's nodes in document order, its text, and what selectors found."""

    def __init__(self):
        self.nodes: list[Node] = []
        self.text = self.html = ""
        self.lines: list[int] | None = None
        self.by: dict[str, dict[str, list[Node]]] | None = None
        self.found: dict[str, tuple[list[Node], list[int]]] = {}
        self.words: tuple[list[int], list[int]] | None = None

    def place(self, line: int, column: int) -> int:
        """Where a line (from 1) and column of the HTML are."""
        if self.lines is None:
            self.lines = [0, *(m.end() for m in re.finditer("\n", self.html))]
        return self.lines[line - 1] + column

    def trimmed_length(self, first: int, last: int) -> int:
        """The length of a stretch of the text without white space at its ends."""
        if self.words is None:
            spans = [m.span() for m in re.finditer(r"\S+", self.text)]
            self.words = [s for s, _ in spans], [e for _, e in spans]
        starts, ends = self.words
        k, j = bisect_right(ends, first), bisect_right(starts, last - 1) - 1
        return max(0, min(ends[j], last) - max(starts[k], first)) if k < len(starts) and j >= k else 0

    def _index(self) -> None:
        self.by = {"tag": defaultdict(list), "id": defaultdict(list), "class": defaultdict(list), "attr": defaultdict(list)}
        for node in self.nodes[1:]:
            self.by["tag"][node.tag].append(node)
            for name in node.attrs:
                self.by["attr"][name].append(node)
            if "id" in node.attrs:
                self.by["id"][node.attrs["id"]].append(node)
            for name in set(node.classes):
                self.by["class"][name].append(node)

    def _candidates(self, names: list[tuple[str, str]]) -> list[Node]:
        """The nodes of the rarest name in a compound."""
        best = None
        for kind, name in names:
            those = self.nodes[1:] if name == "*" and kind == "tag" else self.by[kind].get(name)
            if not those:
                return []
            if best is None or len(those) < len(best):
                best = those
        return best

    def matches(self, selector: str) -> tuple[list[Node], list[int]]:
        """All nodes that a selector names, and their numbers."""
        if selector not in self.found:
            if self.by is None:
                self._index()
            found: dict[int, Node] = {}
            for chain, names in _compiled(selector):
                # How much of the chain the elements around a node meet, in order.
                met: dict[int, int] = {}
                for node in self._candidates(names):
                    if _is(node, chain[-1]) and (len(chain) == 1 or _met(node.parent, chain, met) == len(chain) - 1):
                        found[node.order] = node
            orders = sorted(found)
            self.found[selector] = [found[k] for k in orders], orders
        return self.found[selector]


def _met(node: Node | None, chain: list[list[tuple]], met: dict[int, int]) -> int:
    """How many of a chain's parts but the last a node and those around it
    meet, from the outermost on; each node is looked at once."""
    path = []
    while node is not None and node.order not in met:
        path.append(node)
        node = node.parent
    known = 0 if node is None else met[node.order]
    for node in reversed(path):
        if known < len(chain) - 1 and node.order and _is(node, chain[known]):
            known += 1
        met[node.order] = known
    return known


@cache
def _compiled(selector: str) -> list[tuple[list[list[tuple]], list[tuple[str, str]]]]:
    """Its chains, and the kinds and names that the last part of each asks for."""
    chains = [[[m.groups() for m in _PART.finditer(part)] for part in re.split(r"\s+(?![^\[]*\])", one.strip())] for one in re.split(r",(?![^\[]*\])", selector)]
    return [(chain, [next((k, n) for k, n in zip(("tag", "id", "class", "attr"), p, strict=False) if n) for p in chain[-1]]) for chain in chains]


def _is(node: Node, compound: list[tuple]) -> bool:
    for tag, ident, cls, attr, part, value in compound:
        if tag and tag not in ("*", node.tag):
            return False
        if ident and node.attrs.get("id") != ident:
            return False
        if cls and cls not in node.classes:
            return False
        if attr and (attr not in node.attrs or (value and ((value not in node.attrs[attr]) if part else node.attrs[attr] != value))):
            return False
    return True


class _Builder(HTMLParser):
    """Open elements are a stack; of each tag it is known where they are."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page, self.pieces, self.length = Page(), [], 0
        self.open: list[Node] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self._push("#document", {}, True)

    def _push(self, tag: str, attrs: dict[str, str], stays: bool) -> None:
        parent = self.open[-1] if self.open else None
        node = Node(self.page, len(self.page.nodes), tag, attrs, parent, self.length)
        self.page.nodes.append(node)
        if parent is not None:
            parent.kids += 1
            node.opened = (self.lineno, self.offset, len(self.get_starttag_text()))
            if not stays:
                node.closed = (self.lineno, self.offset)
        if stays:
            self.places[tag].append(len(self.open))
            self.open.append(node)

    def _pop(self, depth: int) -> None:
        """Closes all but the ``depth`` outermost open elements."""
        while len(self.open) > depth:
            node = self.open.pop()
            self.places[node.tag].pop()
            node.end, node.last, node.closed = len(self.page.nodes) - 1, self.length, (self.lineno, self.offset)

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._shut("p", {"button", "table"})
        if tag in ("li", "option", "tr", "td", "th"):
            self._shut(tag, {"ul", "ol", "table", "select"})
        self._push(tag, {k: v or "" for k, v in reversed(attrs)}, tag not in VOID)

    def handle_endtag(self, tag):
        self._shut(tag, set())

    def _shut(self, tag: str, stops: set[str]) -> None:
        """Closes the innermost open ``tag``, unless a stop is open in it."""
        at = self.places[tag][-1] if self.places[tag] else 0
        if at and not any(self.places[s] and self.places[s][-1] > at for s in stops if s != tag):
            self._pop(at)

    def handle_data(self, data):
        self.pieces.append(data)
        self.length += len(data)

    def done(self, html: str) -> Node:
        still = list(self.open)
        self._pop(0)
        for node in still:
            node.closed = None
        self.page.text, self.page.html = "".join(self.pieces), html
        return self.page.nodes[0]


def parse(html: str) -> Node:
    """The tree of a page; malformed pages give what could be read."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.done(html)
