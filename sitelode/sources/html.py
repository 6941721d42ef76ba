"""HTML documents as typed rows: one Arrow pass, everything after it is expressions on columns."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Elements whose text isn't visible, fixed values.
HIDDEN = frozenset(("script", "style", "noscript", "template", "head", "svg"))
LEVELS = ("h1", "h2", "h3", "h4", "h5", "h6")

_MAP = T.MapType(T.StringType(), T.StringType())
_STRINGS = T.ArrayType(T.StringType())
_SCRIPT = T.StructType([T.StructField("src", T.StringType()), T.StructField("deferred", T.BooleanType()), T.StructField("in_head", T.BooleanType()), T.StructField("seq", T.IntegerType()), T.StructField("type", T.StringType())])
_IMG = T.StructType([T.StructField(n, T.StringType()) for n in ("src", "loading", "width", "height", "fetchpriority", "srcset", "alt")] + [T.StructField("sources", T.ArrayType(_MAP))])
PARSED = T.StructType(
    [
        T.StructField("title", T.StringType()), T.StructField("metas", T.ArrayType(_MAP)), T.StructField("headings", T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType())]))),
        T.StructField("heading_sequence", T.ArrayType(T.IntegerType())), T.StructField("links", _STRINGS), T.StructField("link_tags", T.ArrayType(_MAP)), T.StructField("jsonld", _STRINGS), T.StructField("lang", T.StringType()),
        T.StructField("visible_text", T.StringType()), T.StructField("word_count", T.IntegerType()), T.StructField("scripts", T.ArrayType(_SCRIPT)), T.StructField("imgs", T.ArrayType(_IMG)), T.StructField("sources", T.ArrayType(_MAP)),
        T.StructField("stylesheet_seq", T.ArrayType(T.IntegerType())), T.StructField("element_count", T.IntegerType()), T.StructField("viewport_tag", T.BooleanType()), T.StructField("time_tags", T.IntegerType()),
        T.StructField("nosnippet_attrs", T.IntegerType()), T.StructField("address_tags", T.IntegerType()), T.StructField("table_count", T.IntegerType()), T.StructField("list_count", T.IntegerType()), T.StructField("iframes", _STRINGS),
        T.StructField("jsonld_types", _STRINGS), T.StructField("jsonld_valid", T.IntegerType()), T.StructField("jsonld_invalid", T.IntegerType()), T.StructField("head_bytes", T.IntegerType()),
    ]
)


class _Document(HTMLParser):
    """Collects one document. Text inside an unclosed <head> is hidden to the end; an unfinished tag at the end is dropped."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.seq = self.elements = self.times = self.nosnippet = self.addresses = self.tables = self.lists = 0
        self.lang, self.viewport = "", False
        self.hidden: list[str] = []
        self.open_headings: list[tuple[str, list[str]]] = []
        self.title, self.in_title = [], False
        self.texts: list[str] = []
        self.ld: list[str] | None = None
        self.got: dict[str, list] = {k: [] for k in ("metas", "headings", "heading_sequence", "links", "link_tags", "jsonld", "scripts", "imgs", "sources", "stylesheet_seq", "iframes")}
        self.picture: list[dict] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in reversed(attrs)}
        self.elements += 1
        self.seq += 1
        self.nosnippet += "data-nosnippet" in a
        got = self.got
        if tag in HIDDEN:
            self.hidden.append(tag)
        if tag == "html":
            self.lang = self.lang or a.get("lang", "")
        elif tag == "title":
            self.in_title = True
        elif tag == "meta":
            got["metas"].append(a)
            self.viewport |= a.get("name", "").lower() == "viewport"
        elif tag in LEVELS:
            got["heading_sequence"].append(int(tag[1]))
            self.open_headings.append((tag, []))
        elif tag == "a" and "href" in a:
            got["links"].append(a["href"])
        elif tag == "link":
            got["link_tags"].append(a | {"in_noscript": "1" if "noscript" in self.hidden else ""})
            if "stylesheet" in a.get("rel", "").lower():
                got["stylesheet_seq"].append(self.seq)
        elif tag == "script":
            if a.get("type", "").strip().lower() == "application/ld+json":
                self.ld = []
            got["scripts"].append({"src": a.get("src"), "deferred": "async" in a or "defer" in a, "in_head": "head" in self.hidden, "seq": self.seq, "type": a.get("type", "")})
        elif tag == "picture":
            self.picture = []
        elif tag == "source":
            got["sources"].append(a)
            if self.picture is not None:
                self.picture.append(a)
        elif tag == "img":
            got["imgs"].append({k: a.get(k) for k in ("src", "loading", "width", "height", "fetchpriority", "srcset", "alt")} | {"sources": list(self.picture or [])})
        elif tag == "iframe":
            got["iframes"].append(a.get("src", ""))
        self.times += tag == "time" and "datetime" in a
        self.addresses += tag == "address"
        self.tables += tag == "table"
        self.lists += tag in ("ul", "ol")

    def handle_endtag(self, tag: str) -> None:
        if self.hidden and self.hidden[-1] == tag:
            self.hidden.pop()
        if tag == "title":
            self.in_title = False
        elif tag in LEVELS and self.open_headings:
            opened, parts = self.open_headings.pop()
            self.got["headings"].append({"level": int(opened[1]), "text": " ".join("".join(parts).split())})
        elif tag == "script" and self.ld is not None:
            self.got["jsonld"].append("".join(self.ld))
            self.ld = None
        elif tag == "picture":
            self.picture = None

    def handle_data(self, data: str) -> None:
        if self.ld is not None:
            self.ld.append(data)
        if self.in_title:
            self.title.append(data)
        for _, parts in self.open_headings[-1:]:
            parts.append(data)
        if not self.hidden:
            self.texts.append(data)


def nodes(value) -> Iterator[dict]:
    """Every object in a JSON value, the outer ones first."""
    stack = [value]
    while stack:
        at = stack.pop()
        if isinstance(at, dict):
            yield at
            stack.extend(reversed(list(at.values())))
        elif isinstance(at, list):
            stack.extend(reversed(at))


def types_of(node: dict) -> list[str]:
    """The types that a node declares; others than strings don't count."""
    t = node.get("@type")
    return [t] if isinstance(t, str) else [x for x in t if isinstance(x, str)] if isinstance(t, list) else []


def structured(blocks: list[str]) -> tuple[list[str], int, int]:
    """(types in order, valid blocks, invalid blocks) of a document's JSON-LD; blank blocks don't count."""
    seen: dict[str, None] = {}
    valid = invalid = 0
    for raw in blocks:
        if not raw.strip():
            continue
        try:
            value = json.loads(raw)
        except (ValueError, RecursionError):
            invalid += 1
            continue
        valid += 1
        for node in nodes(value):
            for t in types_of(node):
                seen[t] = None
    return list(seen), valid, invalid


#: Members of structured data that name no topic, fixed values.
NO_TOPIC = frozenset(("@context", "@type", "@id", "url", "image", "logo", "sameas", "contenturl", "thumbnailurl", "pricecurrency", "datepublished"))


def schema_text(blocks: list[str]) -> str:
    """The texts that structured data states about its subject: strings under 300 characters that are no address."""
    found = []
    for raw in blocks:
        try:
            value = json.loads(raw)
        except (ValueError, RecursionError):
            continue
        for node in nodes(value):
            found += [v for k, v in node.items() if isinstance(v, str) and k.lower() not in NO_TOPIC and not v.startswith("http") and len(v) < 300]
    return " ".join(found)


def with_schema_text(df: DataFrame, blocks: str = "doc.jsonld") -> DataFrame:
    """``df`` with ``schema_text`` of its structured data, a zone for key phrases."""

    @F.pandas_udf("string")
    def told(col):
        return col.map(lambda own: schema_text(list(own)) if own is not None else "")

    return df.withColumn("schema_text", told(F.col(blocks)))


def parse(text: str | None) -> dict:
    """The record of one document; null and empty documents have empty fields."""
    doc = _Document()
    doc.feed(text or "")
    visible = " ".join(" ".join(doc.texts).split())
    types, valid, invalid = structured(doc.got["jsonld"])
    end = (text or "").lower().find("</head>")
    return doc.got | {
        "title": " ".join("".join(doc.title).split()), "lang": doc.lang, "visible_text": visible, "word_count": len(visible.split(" ")) if visible else 0, "element_count": doc.elements, "viewport_tag": doc.viewport,
        "time_tags": doc.times, "nosnippet_attrs": doc.nosnippet, "address_tags": doc.addresses, "table_count": doc.tables, "list_count": doc.lists, "jsonld_types": types, "jsonld_valid": valid, "jsonld_invalid": invalid,
        "head_bytes": len((text or "")[:end].encode()) if end >= 0 else None,
    }


def parse_html(df: DataFrame, html_col: str) -> DataFrame:
    """``df`` without the HTML column and with the parsed fields (prefixed ``doc``, one struct)."""
    keep = [c for c in df.columns if c != html_col]
    name = "doc" if "doc" not in keep else "_doc"
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(name, PARSED)])
    arrow = to_arrow_schema(PARSED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for a in range(0, len(texts), 256):
                parsed = pa.array([{k: _arrow(v) for k, v in parse(t).items()} for t in texts[a : a + 256]], pa.struct(list(arrow)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, 256) for i in range(len(keep))), parsed], [*keep, name])

    return df.select(*keep, html_col).mapInArrow(run, schema)


def _arrow(v):
    """Maps as pairs, as Arrow wants them."""
    if isinstance(v, list):
        return [[(k, x) for k, x in e.items()] if isinstance(e, dict) and _is_map(e) else {k: ([list(s.items()) for s in x] if k == "sources" else x) for k, x in e.items()} if isinstance(e, dict) else e for e in v]
    return v


def _is_map(e: dict) -> bool:
    return not ({"seq", "level"} & e.keys()) and not ("sources" in e and isinstance(e["sources"], list))


def page_facts(parsed: DataFrame, url: str = "url") -> DataFrame:
    """Facts for the page rules from parsed documents (column ``doc``)."""
    d = lambda f: F.col(f"doc.{f}")

    def meta(key: str):
        hit = F.filter(d("metas"), lambda m: (F.lower(F.coalesce(m["name"], m["property"])) == key))
        return F.coalesce(F.try_element_at(hit, F.lit(1))["content"], F.lit(""))

    refresh = F.try_element_at(F.filter(d("metas"), lambda m: F.lower(m["http-equiv"]) == "refresh"), F.lit(1))["content"]
    imgs = d("imgs")
    steps = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(d("heading_sequence")))), lambda i: F.try_element_at(d("heading_sequence"), i) - F.try_element_at(d("heading_sequence"), i - 1))
    head_scripts = F.filter(d("scripts"), lambda s: s["in_head"] & s["src"].isNotNull() & ~s["deferred"] & (s["type"] != "module"))
    legacy = lambda i: F.lower(i["src"]).rlike(r"\.(jpe?g|png)(\?|$)")
    modern = lambda i: F.lower(F.concat_ws(" ", i["src"], i["srcset"], F.array_join(F.transform(i["sources"], lambda s: F.concat_ws(" ", s["type"], s["srcset"])), " "))).rlike("webp|avif")
    canonical = F.try_element_at(F.filter(d("link_tags"), lambda x: F.lower(x["rel"]).contains("canonical")), F.lit(1))["href"]
    fonts = F.transform(F.filter(d("link_tags"), lambda x: F.lower(x["href"]).contains("fonts.googleapis.com/css") & (x["in_noscript"] == "")), lambda x: x["href"])
    return parsed.withColumns(
        {
            "title": d("title"), "description": F.trim(meta("description")), "lang": d("lang"), "words": d("word_count"), "h1_count": F.size(F.filter(d("headings"), lambda h: h["level"] == 1)),
            "heading_jumps": F.size(F.filter(steps, lambda s: s > 1)), "h2_h4": F.size(F.filter(d("headings"), lambda h: h["level"].between(2, 4))), "imgs": F.size(imgs), "imgs_no_alt": F.size(F.filter(imgs, lambda i: i["alt"].isNull())),
            "imgs_empty_alt": F.size(F.filter(imgs, lambda i: i["alt"] == "")), "imgs_no_size": F.size(F.filter(imgs, lambda i: i["width"].isNull() | i["height"].isNull())), "imgs_lazy": F.size(F.filter(imgs, lambda i: F.lower(i["loading"]) == "lazy")),
            "imgs_legacy": F.size(F.filter(imgs, legacy)), "imgs_modern": F.size(F.filter(imgs, modern)), "jsonld_blocks": d("jsonld_valid") + d("jsonld_invalid"), "jsonld_invalid": d("jsonld_invalid"),
            "question_marks": F.length(d("visible_text")) - F.length(F.replace(d("visible_text"), F.lit("?"), F.lit(""))), "scripts": F.size(F.filter(d("scripts"), lambda s: s["src"].isNotNull())), "script_tags": F.size(d("scripts")),
            "blocking_scripts": F.size(head_scripts), "stylesheets": F.size(d("stylesheet_seq")), "elements": d("element_count"), "nosnippet_attrs": d("nosnippet_attrs"), "viewport_tag": d("viewport_tag"), "viewport": meta("viewport"),
            "meta_robots": meta("robots"), "refresh": refresh, "faq_schema": F.array_contains(d("jsonld_types"), "FAQPage"), "canonical": canonical, "google_fonts": F.size(F.array_distinct(fonts)), "google_font_links": F.size(fonts),
            "fonts_swap": F.forall(fonts, lambda x: x.contains("display=")), "fonts_preconnect": F.exists(d("link_tags"), lambda x: F.lower(x["rel"]).contains("preconnect") & x["href"].contains("fonts.gstatic.com")),
            "has_share_image": (meta("og:image") != "") | (meta("twitter:image") != ""), "client_rendered": (d("word_count") < 20) & (F.size(d("scripts")) >= 3), "dated": d("time_tags") > 0,
        }
    )


def normalize(base: str, href: str) -> str | None:
    """The absolute URL of a link without its fragment; null if it is none."""
    try:
        return urljoin(base, href.strip()).split("#")[0]
    except ValueError:
        return None


def absolute_links(df: DataFrame, base_col: str, links_col: str) -> DataFrame:
    """``df`` with ``absolute``: its links as absolute URLs, distinct, in order."""

    @F.pandas_udf(_STRINGS)
    def joined(bases, links):
        import pandas as pd

        return pd.Series([list(dict.fromkeys(u for h in (own if own is not None else ()) if (u := normalize(b or "", h or "")))) for b, own in zip(bases, links)])

    return df.withColumn("absolute", joined(F.col(base_col), F.col(links_col)))


_GAPS = re.compile(r"[ \t\n\r\f]+")


def srcset_candidates(value: str) -> list[tuple[str, str]]:
    """(URL, descriptor) of a srcset; commas inside URLs are part of them."""
    out, rest = [], value.lstrip(" \t\n\r\f,")
    while rest:
        url, rest = (*_GAPS.split(rest, maxsplit=1), "")[:2]
        if url.endswith(","):
            out.append((url.rstrip(","), ""))
        else:
            depth, i = 0, 0
            while i < len(rest) and not (rest[i] == "," and depth == 0):
                depth += (rest[i] == "(") - (rest[i] == ")")
                i += 1
            out.append((url, rest[:i].strip()))
            rest = rest[i + 1 :]
        rest = rest.lstrip(" \t\n\r\f,")
    return [(u, d) for u, d in out if u and not u.lower().startswith("data:")]


def srcset_weight(descriptor: str) -> float:
    """How large a candidate is: its width, or its density as thousands of pixels; without one the density is 1."""
    m = re.fullmatch(r"([0-9]*\.?[0-9]+)([wx])", descriptor.strip().lower())
    return 1000.0 if not m else float(m.group(1)) * (1 if m.group(2) == "w" else 1000)


def image_size(body: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, GIF, JPEG or WebP."""
    if body[:8] == b"\x89PNG\r\n\x1a\n" and len(body) >= 24:
        return int.from_bytes(body[16:20]), int.from_bytes(body[20:24])
    if body[:6] in (b"GIF87a", b"GIF89a") and len(body) >= 10:
        return int.from_bytes(body[6:8], "little"), int.from_bytes(body[8:10], "little")
    if body[:2] == b"\xff\xd8":
        i = 2
        while i + 9 < len(body) and body[i] == 0xFF:
            marker, size = body[i + 1], int.from_bytes(body[i + 2 : i + 4])
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(body[i + 7 : i + 9]), int.from_bytes(body[i + 5 : i + 7])
            i += 2 + max(size, 2)
    if body[:4] == b"RIFF" and body[8:16] == b"WEBPVP8X" and len(body) >= 30:
        return int.from_bytes(body[24:27], "little") + 1, int.from_bytes(body[27:30], "little") + 1
    return None


#: Hosts of search engines whose links are no results, fixed values.
ENGINE_HOSTS = ("brave.com", "brave.app", "w3.org", "hackerone.com")
_ASSET = re.compile(r"\.(?:png|jpe?g|gif|webp|avif|svg|ico|css|js|mjs|woff2?|ttf|otf|eot|mp4|webm|json|xml|webmanifest|map)$", re.I)


def is_result_url(url: str) -> bool:
    """An http(s) URL that is neither the engine's own, nor a map, nor an asset."""
    try:
        parts = urlsplit(url)
    except ValueError:
        return False
    host = (parts.hostname or "").lower()
    if parts.scheme not in ("http", "https") or not host or any(host == h or host.endswith("." + h) for h in ENGINE_HOSTS):
        return False
    return not (host.startswith("maps.google.") or (re.search(r"(^|\.)google\.", host) and parts.path.startswith("/maps")) or _ASSET.search(parts.path))
