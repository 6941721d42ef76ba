"""Exported result pages (two providers' JSON) as flat rows: organic results, local places, features."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sitelode.sources.json_payloads import whole_value

#: Members of the one provider that list features, and their kind, fixed values.
FEATURES = {"inline_videos": "video", "top_stories": "news", "related_questions": "faq", "ads": "ad", "inline_images": "image", "knowledge_graph": "infobox"}
#: Item types of the other provider that list features, and their kind, fixed values.
ITEM_FEATURES = {"video": "video", "top_stories": "news", "people_also_ask": "faq", "paid": "ad", "images": "image", "knowledge_graph": "infobox", "featured_snippet": "ai_answer", "ai_overview": "ai_answer"}


def number(v):
    """A number, or the number that a text is; null else. A boolean is none."""
    if isinstance(v, bool):
        return None
    if isinstance(v, (int, float)):
        return v
    if isinstance(v, str):
        try:
            return float(v.replace(",", ""))
        except ValueError:
            return None
    return None


def integer(v):
    n = number(v)
    return int(n) if n is not None and n == n and abs(n) < 2**63 else None


def text(v):
    return v if isinstance(v, str) else None


def detect(value) -> str:
    """serpapi, dataforseo, mixed list or foreign, by its members."""
    if isinstance(value, list):
        return "list" if value and all(isinstance(x, dict) and detect(x) != "foreign" for x in value) else "foreign"
    if not isinstance(value, dict):
        return "foreign"
    if isinstance(value.get("tasks"), list) or (isinstance(value.get("items"), list) and ("keyword" in value or "se_domain" in value)):
        return "dataforseo"
    return "serpapi" if any(k in value for k in ("organic_results", "search_parameters", "local_results")) else "foreign"


def _host(url) -> str:
    m = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", (url or "").lower())
    return re.sub(r"^www\.", "", m.group(1)) if m else ""


def _row(kind, query, engine, position, url, domain, title, rating=None, reviews=None):
    return kind, text(query), text(engine), integer(position), text(url), domain, text(title), number(rating), integer(reviews)


def serpapi_rows(v: dict) -> Iterator[tuple]:
    params = v.get("search_parameters") if isinstance(v.get("search_parameters"), dict) else {}
    query, engine = params.get("q"), params.get("engine")
    for r in v.get("organic_results") or []:
        if isinstance(r, dict) and text(r.get("link")):
            yield _row("organic", query, engine, r.get("position"), r["link"], _host(r["link"]), r.get("title"))
    local = v.get("local_results")
    places = local if isinstance(local, list) else local.get("places") if isinstance(local, dict) and isinstance(local.get("places"), list) else []
    for p in places:
        if isinstance(p, dict) and text(p.get("title")):
            links = p.get("links") if isinstance(p.get("links"), dict) else {}
            site = text(p.get("website")) or text(links.get("website"))
            yield _row("local", query, engine, p.get("position"), site, _host(site), p["title"], p.get("rating"), p.get("reviews"))
    for member, kind in FEATURES.items():
        held = v.get(member)
        for r in held if isinstance(held, list) else [held] if isinstance(held, dict) else []:
            if isinstance(r, dict):
                url = text(r.get("link")) or text(r.get("website"))
                yield _row(f"feature:{kind}", query, engine, None, url, _host(url), r.get("title"))


def dataforseo_rows(v: dict) -> Iterator[tuple]:
    results = []
    for task in v.get("tasks") or []:
        if isinstance(task, dict):
            data = task.get("data") if isinstance(task.get("data"), dict) else {}
            results += [(data, r) for r in task.get("result") or [] if isinstance(r, dict)]
    if "items" in v:
        results.append(({}, v))
    for data, r in results:
        query, engine = r.get("keyword") or data.get("keyword"), data.get("se") or r.get("se_domain")
        for item in r.get("items") or []:
            if not isinstance(item, dict):
                continue
            kind = item.get("type")
            if kind == "organic" and text(item.get("url")):
                yield _row("organic", query, engine, item.get("rank_group"), item["url"], text(item.get("domain")) or _host(item["url"]), item.get("title"))
            elif kind in ("local_pack", "maps_search") and text(item.get("title")):
                rating = item.get("rating") if isinstance(item.get("rating"), dict) else {}
                yield _row("local", query, engine, item.get("rank_group"), item.get("url"), text(item.get("domain")) or _host(text(item.get("url"))), item["title"], rating.get("value"), rating.get("votes_count"))
            elif kind in ITEM_FEATURES:
                for e in item.get("items") if isinstance(item.get("items"), list) else [item]:
                    if isinstance(e, dict):
                        yield _row(f"feature:{ITEM_FEATURES[kind]}", query, engine, None, e.get("url"), _host(text(e.get("url"))), e.get("title"))


def rows_of(value) -> Iterator[tuple]:
    """Rows of one readable payload; a foreign one has a single row of kind 'error'."""
    kind = detect(value)
    if kind == "list":
        for v in value:
            yield from rows_of(v)
    elif kind == "serpapi":
        yield from serpapi_rows(value)
    elif kind == "dataforseo":
        yield from dataforseo_rows(value)
    else:
        yield ("error", None, None, None, None, None, "foreign payload", None, None)


ROWS = "seq int, kind string, query string, engine string, position long, url string, domain string, title string, rating double, reviews long"


def flat_rows(df: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """(id, seq, kind, query, engine, position, url, domain, title, rating, reviews) of every payload; bad ones as kind 'error'."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *T._parse_datatype_string(ROWS)])
    types = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, payload in enumerate(batch.column(1).to_pylist()):
                ok, value = whole_value(payload)
                own = rows_of(value) if ok else [("error", None, None, None, None, None, "null payload" if payload is None else "not one JSON value", None, None)]
                for seq, r in enumerate(own):
                    at.append(i)
                    rows.append((seq, *r))
            cols = list(zip(*rows)) or [[]] * 10
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), t) for c, t in zip(cols, types))], schema.names)

    return df.select(id_col, payload_col).mapInArrow(run, schema)
