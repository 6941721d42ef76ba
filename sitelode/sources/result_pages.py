"""Result pages captured as HTML: organic results, local places and features as flat rows.

The document becomes a light tree first; what a block holds is then asked of its subtree. Malformed markup closes
what it can: an end tag closes everything up to the element it names, and is ignored where that isn't open.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sitelode.sources.html import is_result_url
from sitelode.sources.serp_payloads import _host

#: Ids of sections that hold the main results, ids of elements that are blocks of a kind, kinds that hold no results. Fixed values.
MAIN_SECTIONS = ("mixed-top", "mixed-main")
ID_KINDS = {
    "faq": "faq", "discussions": "discussions", "locations": "local", "llm-snippet": "ai_answer", "infobox": "infobox", "infobox-snippet": "infobox",
    "search-elsewhere": "", "related-queries": "", "pagination-snippet": "",
}
#: Signs of a page that asks whether a person is there, fixed values.
CHALLENGE = (r'page:"/captcha"', "flagged as being suspicious", r"https?://[^\"\s]*torproject\.org")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CHALLENGE = re.compile("|".join(CHALLENGE), re.I)


class Element:
    """A tag with its attributes, and the elements and texts in it, in order."""

    __slots__ = ("tag", "attrs", "inside")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.inside = tag, attrs, []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def below(self) -> Iterator[Element]:
        """Every element inside, in document order."""
        stack = [x for x in reversed(self.inside) if isinstance(x, Element)]
        while stack:
            at = stack.pop()
            yield at
            stack += [x for x in reversed(at.inside) if isinstance(x, Element)]

    def text(self) -> str:
        parts, stack = [], [self]
        while stack:
            at = stack.pop()
            if isinstance(at, str):
                parts.append(at)
            else:
                stack += reversed(at.inside)
        return " ".join("".join(parts).split())


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a" and any(e.tag == "a" for e in self.open):
            self.handle_endtag("a")
        new = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].inside.append(new)
        if tag not in VOID:
            self.open.append(new)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].inside.append(data)


def tree(html: str | None) -> Element:
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    return parser.root


def blocks(root: Element) -> Iterator[tuple[str, Element]]:
    """(kind, element) of the outermost blocks, in order."""
    stack = [(x, False) for x in reversed(root.inside) if isinstance(x, Element)]
    while stack:
        at, main = stack.pop()
        name = at.attrs.get("id", "").strip()
        main = main or (at.tag == "section" and name in MAIN_SECTIONS)
        marked = at.attrs.get("data-type", "").strip().lower() if at.tag == "div" else ""
        if marked or name in ID_KINDS:
            yield marked or ID_KINDS[name], at
        elif at.tag == "div" and "snippet" in at.classes and not name and main:
            yield "entity", at
        else:
            stack += [(x, main) for x in reversed(at.inside) if isinstance(x, Element)]


def _links(at: Element) -> list[tuple[str, str]]:
    own = ((e.attrs.get("href", "").strip(), e) for e in at.below() if e.tag == "a")
    return [(u, e.text()) for u, e in own if u.lower().startswith(("http://", "https://"))]


def _key(url: str) -> str:
    return re.sub(r"/$", "", url.split("#")[0])


def _distinct(links: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The links that may be results, the first of each address."""
    out: dict[str, tuple[str, str]] = {}
    for url, text in links:
        if is_result_url(url):
            out.setdefault(_key(url), (url, text))
    return list(out.values())


def _title(block: Element) -> str:
    named = (e.attrs.get("title", "").strip() or e.text() for e in block.below() if {"title", "search-snippet-title"} & set(e.classes))
    return next((" ".join(t.split()) for t in named if t), "")


def _places(block: Element) -> Iterator[tuple[str, float | None, int | None]]:
    """(title, rating, reviews) of a block's outermost list items that have a title."""
    items, stack = [], [x for x in reversed(block.inside) if isinstance(x, Element)]
    while stack:
        at = stack.pop()
        if at.tag == "li":
            items.append(at)
        else:
            stack += [x for x in reversed(at.inside) if isinstance(x, Element)]
    for item in items:
        said = lambda c: [e.text() for e in item.below() if e.tag == "div" and c in e.classes]  # noqa: B023, E731
        title, rating, reviews = (next((t for t in said(c) if t), "") for c in ("title", "rating", "review-count"))
        if title:
            number, digits = re.search(r"\d+(?:\.\d+)?", rating), re.sub(r"\D", "", reviews)
            yield title, float(number.group()) if number else None, int(digits) if digits else None


def rows_of(html: str | None) -> Iterator[tuple]:
    """(kind, parse_mode, position, url, domain, title, slot, rating, reviews) of a page's results, places and features.

    A page without web blocks falls back on all its external links. A page that asks for a person has the one row 'challenge'.
    """
    if _CHALLENGE.search(html or ""):
        yield "challenge", "challenge", None, None, None, None, None, None, None
        return
    root = tree(html)
    found = list(blocks(root))
    organic: dict[str, tuple] = {}
    for kind, block in found:
        first = next(iter(_distinct(_links(block))), None) if kind == "web" else None
        if first:
            slot = block.attrs.get("data-pos", "").strip()
            organic.setdefault(_key(first[0]), (first[0], _title(block) or first[1], int(slot) if slot.isdigit() else None))
    mode = "blocks" if organic else "fallback"
    for place, (url, title, slot) in enumerate(list(organic.values()) or [(u, t, None) for u, t in _distinct(_links(root))], 1):
        yield "organic", mode, place, url, _host(url), title, slot, None, None
    places = (p for kind, block in found if kind == "local" for p in _places(block))
    for place, (title, rating, reviews) in enumerate(places, 1):
        yield "local", mode, place, None, "", title, None, rating, reviews
    for kind, block in found:
        if kind == "ad":
            landing = block.attrs.get("data-landing-page", "").strip()
            if is_result_url(landing):
                yield "feature:ad", mode, None, landing, _host(landing), " ".join(block.attrs.get("data-headline-text", "").split()), None, None, None
        elif kind not in ("", "web", "local"):
            if kind == "cluster" and any(c.startswith("video-cluster") for e in (block, *block.below()) for c in e.classes):
                kind = "video"
            for url, text in _distinct(_links(block)):
                yield f"feature:{kind}", mode, None, url, _host(url), text[:160], None, None, None


ROWS = "seq int, kind string, parse_mode string, position int, url string, domain string, title string, slot int, rating double, reviews long"


def flat_rows(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, seq, kind, ...) rows of every captured result page; null and empty pages have none."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *T._parse_datatype_string(ROWS)])
    kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, html in enumerate(batch.column(1).to_pylist()):
                for seq, row in enumerate(rows_of(html)):
                    at.append(i)
                    rows.append((seq, *row))
            cols = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], schema.names)

    return df.select(id_col, html_col).mapInArrow(run, schema)
