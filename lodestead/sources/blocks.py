"""Landed pages as trees of elements, and selections from them.

A page is parsed once, a few pages of an Arrow batch at a time, into a column of two arrays: its pieces of text in order, and its elements with
their tags, classes, attributes, and the ranges of elements and text that lie within them. Selections are built-in
functions on that column.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.normalize import trimmed

TREE = "struct<texts:array<string>,nodes:array<struct<at:int,tag:string,classes:array<string>,attrs:map<string,string>,last:int,text_from:int,text_to:int>>>"
#: Elements without content, those whose text is not shown, and those that end where one of their kind begins.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(("script", "style"))
NO_NESTING = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

#: The shape of TREE in Arrow, and the characters of pages whose trees are held at once (a page of its own, if longer).
ARROW = pa.struct({
    "texts": pa.list_(pa.string()),
    "nodes": pa.list_(pa.struct({"at": pa.int32(), "tag": pa.string(), "classes": pa.list_(pa.string()), "attrs": pa.map_(pa.string(), pa.string()), "last": pa.int32(), "text_from": pa.int32(), "text_to": pa.int32()})),
})
HELD = 1 << 20


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.nodes: list[list] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        if self.open and self.nodes[self.open[-1]][1] in NO_NESTING.get(tag, ()):
            self.close_last()
        named = {k: v or "" for k, v in reversed(attrs)}  # the first of a name counts
        self.nodes.append([len(self.nodes), tag, named.get("class", "").split(), list(named.items()), len(self.nodes), len(self.texts), len(self.texts)])
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.close_last()

    def handle_endtag(self, tag):
        if any(self.nodes[k][1] == tag for k in self.open):  # an end without a beginning is passed over
            while self.close_last() != tag:
                pass

    def handle_data(self, data):
        if not (self.open and self.nodes[self.open[-1]][1] in HIDDEN):
            self.texts.append(data)

    def close_last(self) -> str:
        node = self.nodes[self.open.pop()]
        node[4], node[6] = len(self.nodes) - 1, len(self.texts)
        return node[1]


def _tree(html: str | None) -> dict | None:
    if html is None:
        return None
    reader = _Reader()
    reader.feed(html)
    reader.close()
    while reader.open:
        reader.close_last()
    names = ("at", "tag", "classes", "attrs", "last", "text_from", "text_to")
    return {"texts": reader.texts, "nodes": [dict(zip(names, n, strict=True)) for n in reader.nodes]}


def _slices(batch: pa.Array, held: int) -> Iterator[pa.Array]:
    """The batch in order, in parts of about so many bytes."""
    begin = size = 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(batch), 0).to_pylist()):
        if size and size + n > held:
            yield batch.slice(begin, k - begin)
            begin, size = k, 0
        size += n + 1
    yield batch.slice(begin)


def tree(html: Column) -> Column:
    """The page as texts and nodes; null fields for a null page.

    Trees are many times as large as their pages, so they leave the task part by part, not batch by batch.
    """

    @F.arrow_udf(TREE)
    def parsed(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in pages:
            for some in _slices(batch, HELD):
                yield pa.array([_tree(x) or {"texts": None, "nodes": None} for x in some.to_pylist()], ARROW)

    return parsed(html)


def select(page: Column, test, within: Column | None = None) -> Column:
    """The elements of a page for which ``test`` holds, in order; those below one of the elements ``within``, if given."""
    found = F.filter(page["nodes"], test)
    if within is None:
        return found
    return F.filter(found, lambda n: F.exists(within, lambda a: (n["at"] > a["at"]) & (n["at"] <= a["last"])))


def has_class(*names: str):
    return lambda n: F.arrays_overlap(n["classes"], F.array(*map(F.lit, names)))


def is_tag(*names: str):
    return lambda n: n["tag"].isin(*names)


def both(*tests):
    def every(n):
        found = tests[0](n)
        for t in tests[1:]:
            found &= t(n)
        return found

    return every


def attribute(node: Column, *names: str) -> Column:
    """The first of the attributes that is there and not empty."""
    return F.coalesce(*[F.nullif(F.try_element_at(node["attrs"], F.lit(n)), F.lit("")) for n in names])


def text(page: Column, node: Column) -> Column:
    """All text within an element, trimmed; null where there is no element."""
    return F.when(node.isNotNull(), trimmed(F.array_join(F.slice(page["texts"], node["text_from"] + 1, node["text_to"] - node["text_from"]), "")))


def first(nodes: Column) -> Column:
    return F.get(nodes, F.lit(0))
