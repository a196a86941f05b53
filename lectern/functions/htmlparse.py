"""Scientific HTML pages as sections of typed blocks, with the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EQUATION_LIMIT = 200
MARKER = "[EQUATION]"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SILENT = frozenset(("script", "style", "template"))
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def walk(self) -> Iterator[Node]:
        """All elements below, in the order of the document."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def first(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def text(self) -> str:
        parts, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                parts.append(n)
            elif n.tag not in _SILENT:
                stack += reversed(n.children)
        return "".join(parts)

    def has(self, *classes: str) -> bool:
        own = self.attrs.get("class", "").split()
        return any(c in own for c in classes)

    def nearest(self, *tags: str) -> Node | None:
        n = self.parent
        while n is not None and n.tag not in tags:
            n = n.parent
        return n

    def inside(self, test) -> bool:
        n = self.parent
        while n is not None:
            if test(n):
                return True
            n = n.parent
        return False

    def drop(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def serial(self) -> str:
        return f"<{self.tag} {sorted(self.attrs.items())}>" + "".join(c if isinstance(c, str) else c.serial() for c in self.children) + "</>"


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("[document]")
        self.at = self.root

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES_P:
            self._close("p", ("section", "div", "table", "figure", "td", "th", "li", "body"))
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(n)
        if tag not in _VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def _close(self, tag, until=()):
        n = self.at
        while n is not None and n.tag != tag:
            if n.tag in until or n is self.root:
                return
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def tidy(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def table_markdown(node: Node) -> str:
    """A table as Markdown with its caption: the first row is the header, short rows are filled up."""
    cap = node.first("figcaption", "caption")
    caption = f"[{tidy(cap.text())}]" if cap is not None and tidy(cap.text()) else ""
    table = node if node.tag == "table" else node.first("table")
    grid = [[tidy(c.text()).replace("|", "\\|") for c in row.walk() if c.tag in ("td", "th")] for row in (table.walk() if table is not None else ()) if row.tag == "tr"]
    grid = [r for r in grid if r]
    if not grid:
        return caption
    width = max(map(len, grid))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in grid]
    rule = "| " + " | ".join(["---"] * width) + " |"
    return "\n".join(([caption] if caption else []) + [lines[0], rule, *lines[1:]])


def _is_bibliography(heading: str, by_word: bool) -> bool:
    low = heading.lower()
    return bool(re.search(r"\b(?:references|bibliography)\b", low)) if by_word else "references" in low or "bibliography" in low


def _math(node: Node) -> str:
    m = node if node.tag == "math" else node.first("math")
    return m.attrs.get("alttext", "") if m is not None else tidy(node.text())


def parse(html: str | None, flat: str = "body", bibliography_by_word: bool = False) -> list[dict]:
    """The sections of a page: ``{section_id, heading, blocks: [{section_id, type, content}]}``.

    Bibliographies are dropped, inline formulas become ``$...$``, the abstract is
    a section of its own. An element belongs to the nearest section; of equal
    elements of a section the first counts. A page without sections is one
    section, ``body``, unless ``flat`` is ``strict``. Null and empty pages have none.
    """
    if not html:
        return []
    root = tree(html)
    for n in [n for n in root.walk() if n.has("ltx_bibliography")]:
        n.drop()
    for n in list(root.walk()):
        if n.tag in ("section", "div") and n.parent is not None:
            h = n.first(*_HEADINGS)
            if h is not None and _is_bibliography(h.text(), bibliography_by_word):
                n.drop()

    def displayed(n: Node) -> bool:
        return n.has("ltx_equation", "ltx_equationgroup")

    for m in [n for n in root.walk() if n.tag == "math" and not n.inside(displayed)]:
        if m.parent is not None:
            alt = m.attrs.get("alttext")
            said = f" ${alt}$ " if alt else m.text()
            m.parent.children = [said if c is m else c for c in m.parent.children]
    out = []
    abstract = next((n for n in root.walk() if n.has("ltx_abstract")), None)
    if abstract is not None:
        h = abstract.first(*_HEADINGS)
        said = [tidy(p.text()) for p in abstract.walk() if p.tag == "p"]
        out.append({"section_id": "abstract", "heading": tidy(h.text()) if h is not None and tidy(h.text()) else "Abstract", "blocks": [{"section_id": "abstract", "type": "text", "content": x} for x in said if x]})
        abstract.drop()
    sections = [n for n in root.walk() if n.tag == "section"]
    whole = not sections
    if whole:
        if flat == "strict":
            return out
        sections = [root.first("body") or root]
    for number, sec in enumerate(sections, 1):
        sid = "body" if whole else sec.attrs.get("id") or f"sec_{number}"

        def owned(n: Node) -> bool:
            return whole or n.nearest("section") is sec

        h = next((n for n in sec.walk() if n.tag in _HEADINGS and owned(n)), None)
        blocks, used, seen = [], set(), set()

        def add(node: Node, kind: str, content: str) -> None:
            if content and (mark := node.serial()) not in seen:
                seen.add(mark)
                blocks.append({"section_id": sid, "type": kind, "content": content})

        for n in sec.walk():
            if id(n) in used or not owned(n):
                continue
            kind = None
            if n.tag == "figure" and n.has("ltx_figure"):
                cap = n.first("figcaption")
                kind, content = "figure", f"[{tidy(cap.text())}]" if cap is not None and tidy(cap.text()) else ""
            elif n.tag == "figure" and n.has("ltx_table") or n.tag == "table" and n.has("ltx_tabular"):
                kind, content = "table", table_markdown(n)
            elif displayed(n):
                f = _math(n)
                kind, content = "equation", MARKER if len(f) > EQUATION_LIMIT else f"$${f}$$"
            elif n.tag == "p" and not n.inside(lambda a: a.tag in ("figure", "figcaption", *_HEADINGS)):
                kind, content = "text", tidy(n.text())
            if kind:
                used.update(id(x) for x in n.walk())
                add(n, kind, content)
        heading = tidy(h.text()) if h is not None else ""
        if blocks or heading:
            out.append({"section_id": sid, "heading": heading, "blocks": blocks})
    return out


_BLOCK = pa.struct([("section_id", pa.string()), ("type", pa.string()), ("content", pa.string())])
_SECTIONS = pa.list_(pa.struct([("section_id", pa.string()), ("heading", pa.string()), ("blocks", pa.list_(_BLOCK))]))


def parse_pages(pages: DataFrame, key: str = "arxiv_id", html: str = "html", flat: str = "body", bibliography_by_word: bool = False) -> DataFrame:
    """``(<key>, sections, total_words, block_counts)`` of every page; null pages have no sections."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parse(x, flat, bibliography_by_word) for x in b.column(1).to_pylist()], _SECTIONS)], names=[key, "sections"])

    parsed = pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, sections array<struct<section_id:string, heading:string, blocks:array<struct<section_id:string, type:string, content:string>>>>")
    blocks = F.flatten(F.transform("sections", lambda s: s["blocks"]))
    words = F.aggregate(blocks, F.lit(0), lambda n, x: n + F.size(F.filter(F.split(x["content"], r"(?U)\s+"), lambda w: w != "")))

    def number(kind: str):
        return F.size(F.filter(blocks, lambda x: x["type"] == kind))

    counts = F.create_map(*[y for t in ("text", "table", "figure", "equation") for y in (F.lit(t), number(t))])
    return parsed.withColumn("total_words", words).withColumn("block_counts", counts)
