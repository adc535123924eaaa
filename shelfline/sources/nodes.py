"""Pages into rows of selected nodes.

One Python step a page parses the HTML and emits, for every card and every
field, the nodes that the field's selectors find, in the order in which they
would be tried.  What a field makes of its nodes is said in column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from shelfline.functions.js import WHITE
from shelfline.sources.dom import Node, parse

_RUN = re.compile(f"{WHITE}+")

#: Rows, and characters of their texts, of a batch of node rows.
ROWS, CHARACTERS = 5000, 4_000_000

NODE = "page bigint, card int, name string, at array<int>, text string, attrs map<string,string>, up array<string>"


@dataclass(frozen=True)
class Pick:
    """A field's selectors, in tiers that are tried one after another.

    ``within``: an outer selector; nodes are looked for in each of its
    matches, whose attributes they get, or their ``own``.  ``longest``: longer texts are left
    out.  ``leaf``: only elements without elements.  ``up``: texts that are
    shorter, runs of white space counted as one, bring the texts of their
    ancestors within the card.  ``source``: the text is what is written between
    the element's tags, markup and entities as they are.  ``has``: a pattern
    found in the text or in an attribute of ``attrs``; nodes without it, of
    which no rule makes anything, give no row.
    """

    name: str
    tiers: tuple[str, ...]
    attrs: tuple[str, ...] = ()
    within: str = ""
    own: bool = False
    longest: int = 0
    leaf: bool = False
    up: int = 0
    first_tier: int = 0
    source: bool = False
    has: str = ""

    def nodes(self, card: Node) -> Iterator[tuple[list[int], Node, Node]]:
        if self.within:
            for k, outer in enumerate(card.select(self.within)):
                for tier, selector in enumerate(self.tiers):
                    for i, node in enumerate(outer.select(selector)):
                        yield [self.first_tier, k, tier, i], node, node if self.own else outer
        else:
            for tier, selector in enumerate(self.tiers):
                for i, node in enumerate(card.select(selector)):
                    yield [self.first_tier + tier, 0, 0, i], node, node

    def rows(self, card: Node) -> Iterator[tuple]:
        seen = set()
        has = re.compile(self.has).search if self.has else None
        for at, node, holder in self.nodes(card):
            if self.own and self.within:
                # In a region within another the same node comes again, later.
                if (at[2], node.order) in seen:
                    continue
                seen.add((at[2], node.order))
            if self.longest and node.page.trimmed_length(node.first, node.last) > self.longest or self.leaf and node.kids:
                continue
            text = node.source() if self.source else node.text()
            if has and not has(text) and not any(has(holder.attrs[a]) for a in self.attrs if a in holder.attrs):
                continue
            attrs = {a: holder.attrs[a] for a in self.attrs if a in holder.attrs}
            attrs["#tag"] = node.tag
            if node.under:
                attrs["#heading"] = "true"
            up = []
            if self.up and (short := len(_RUN.sub(" ", text).strip())) < self.up:
                for above in node.wider():
                    if above.order <= card.order:
                        break
                    up.append(above.text())
                    # More than twice as long, a word before it aside: no wider one is asked for.
                    if len(_RUN.sub(" ", up[-1]).strip()) > 2 * short + 12:
                        break
            yield self.name, at, text, list(attrs.items()), up


@dataclass(frozen=True)
class Spec:
    """What is read of a page: cards and their fields, and the page's own."""

    cards: Callable[[Node], list[Node]]
    fields: tuple[Pick, ...]
    page: tuple[Pick, ...] = ()
    card_attrs: tuple[str, ...] = field(default=())


def _card_rows(card: Node, spec: Spec, picks: tuple[Pick, ...]) -> list[tuple]:
    found = [row for pick in picks for row in pick.rows(card)]
    if picks is not spec.page:
        attrs = [(a, card.attrs[a]) for a in spec.card_attrs if a in card.attrs]
        found.append(("card", _FIRST, card.text(), attrs, []))
    return found


_FIRST = [0, 0, 0, 0]


def _page_rows(spec: Spec, html: str | None) -> Iterator[tuple]:
    yield -1, "page", _FIRST, "", [], []
    if not html:
        return
    root = parse(html)
    whole = [(-1, root, spec.page)]
    try:
        whole += [(k, card, spec.fields) for k, card in enumerate(spec.cards(root))]
    except Exception as e:  # noqa: BLE001  it is reported, and the page's own rows stay
        yield -1, "unreadable", _FIRST, repr(e), [], []
    for number, card, picks in whole:
        try:
            found = _card_rows(card, spec, picks)
        except Exception as e:  # noqa: BLE001  it is reported, and the other cards stay
            found = [("unreadable", _FIRST, repr(e), [], [])]
        for row in found:
            yield number, *row


def node_batches(pages: Iterable[tuple], specs: dict[str, Spec], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The node rows of pages (page, reader, html, and what each row carries
    besides), ROWS at most in a batch, and no more once CHARACTERS of text are."""
    part: list[tuple] = []
    size = 0

    def out() -> pa.RecordBatch:
        values = zip(*part, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    for page, reader, html, *kept in pages:
        for row in _page_rows(specs[reader], html) if reader in specs else ():
            part.append((page, *row, reader, *kept))
            size += len(row[3])
            if len(part) >= ROWS or size >= CHARACTERS:
                yield out()
                part, size = [], 0
    if part:
        yield out()


def select_nodes(pages: DataFrame, specs: dict[str, Spec], keep: Sequence[str] = ()) -> DataFrame:
    """Node rows of ``pages`` (page, reader, html); ``reader`` names the spec.

    Rows of the page itself have card -1; of each page with a known reader one
    is named "page", even where its HTML is null or empty.  A card that cannot
    be read, or a page whose cards cannot be told, gives a row "unreadable"
    with the reason, and the others stay.  ``keep``: columns of ``pages`` that
    every row carries.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType([*StructType.fromDDL(NODE).fields, *[pages.schema[c] for c in ("reader", *keep)]])
    arrow = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from node_batches(zip(*(c.to_pylist() for c in batch.columns), strict=True), specs, arrow)

    return pages.select("page", "reader", "html", *keep).mapInArrow(rows, schema)
