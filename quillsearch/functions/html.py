"""HTML to headed sections: a small tree builder and the sectioning walk."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import sliced

_ITEMS = T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("pow", T.IntegerType()), T.StructField("content", T.StringType())]))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements before whose start an open paragraph ends.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SKIP = frozenset(("table", "style", "script", "math"))
HEADINGS = re.compile(r"h[1-6]$")
#: Raw text: tags in them are none.
RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"))


class Element:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs=()):
        self.name, self.attrs, self.children = name, dict(attrs), []

    def has(self, word: str) -> bool:
        return word in (self.attrs.get("class") or "")


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("")
        self.open = [self.root]

    def close_to(self, names: tuple[str, ...], until: frozenset[str]) -> None:
        """Close the nearest open element of the names, unless one of until is nearer."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name in names:
                del self.open[k:]
                return
            if self.open[k].name in until:
                return

    def handle_starttag(self, tag: str, attrs) -> None:
        scope = frozenset(("table", "td", "th", "caption", "button", "object"))
        if tag in ENDS_P:
            self.close_to(("p",), scope)
        if HEADINGS.match(tag) and HEADINGS.match(self.open[-1].name):
            self.open.pop()
        if tag == "li":
            self.close_to(("li",), scope | {"ul", "ol", "menu"})
            self.close_to(("p",), scope | {"ul", "ol", "li"})
        elif tag in ("dt", "dd"):
            self.close_to(("dt", "dd"), scope | {"dl"})
            self.close_to(("p",), scope | {"dl", "dd", "dt"})
        elif tag in ("td", "th"):
            self.close_to(("td", "th"), frozenset(("table",)))
        elif tag == "tr":
            self.close_to(("tr",), frozenset(("table",)))
        elif tag == "option":
            self.close_to(("option",), frozenset(("select",)))
        element = Element(tag, attrs)
        self.open[-1].children.append(element)
        if tag not in VOID:
            self.open.append(element)

    def handle_startendtag(self, tag: str, attrs) -> None:
        # a trailing slash means nothing but on void elements
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if HEADINGS.match(tag):
            names = tuple(f"h{k}" for k in range(1, 7))
        else:
            names = (tag,)
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name in names:
                del self.open[k:]
                return
        if tag == "p":
            self.open[-1].children.append(Element("p"))

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str) -> Element:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def external(node) -> bool:
    """Whether a link marked as external is anywhere inside."""
    todo = [node]
    while todo:
        e = todo.pop()
        if isinstance(e, Element):
            if e.name == "a" and e.has("external"):
                return True
            todo += e.children
    return False


def hidden(e: Element) -> bool:
    return e.name in SKIP or e.name == "sup" and e.has("reference")


def text_of(node, depth: int = 0) -> str:
    """All text inside; list items get a bullet and a tab for each list item around."""
    out: list[str] = []
    todo = [(node, depth)]
    while todo:
        e, d = todo.pop()
        if isinstance(e, str):
            out.append(e)
            continue
        if hidden(e):
            continue
        if e.name == "li":
            out.append("\t" * d + "• ")
            d += 1
        todo += [(c, d) for c in reversed(e.children)]
    return "".join(out)


def sections(html: str | None) -> list[dict]:
    """Sections {title, pow, content} in order of first appearance."""
    groups: dict[str, dict] = {}
    heading, level = "", 0

    def add(text: str) -> None:
        if text := text.strip():
            groups.setdefault(heading, {"title": heading, "pow": level, "texts": []})["texts"].append(text)

    todo = [parse(html or "")]
    while todo:
        e = todo.pop()
        if isinstance(e, str) or hidden(e):
            continue
        if e.name in ("ul", "ol"):
            texts = []
            for item in e.children:
                if isinstance(item, Element) and item.name == "li" and not external(item):
                    if (text := text_of(item)).strip():
                        texts.append("\n" + text)
                    item.children = []
            if texts:
                add("".join(texts))
        elif e.name == "p":
            add(text_of(e))
        elif HEADINGS.match(e.name):
            if (text := text_of(e)).strip():
                heading, level = text, int(e.name[1])
        todo += reversed(e.children)
    out = []
    for g in groups.values():
        content = "\n\n".join(t for t in g["texts"] if t != g["title"]).strip()
        if content:
            out.append({"title": g["title"], "pow": g["pow"], "content": content})
    return out


_KIND = pa.list_(pa.struct([("title", pa.string()), ("pow", pa.int32()), ("content", pa.string())]))


@F.arrow_udf(_ITEMS)
def sectioned(html: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return sliced(html, sections, _KIND)


# else a filter on the sections, also one that exploding them implies, would parse all pages again
sectioned = sectioned.asNondeterministic()


@F.arrow_udf(T.BooleanType())
def has_external(html: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return sliced(html, lambda h: external(parse(h or "")), pa.bool_())
