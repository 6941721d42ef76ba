"""Facts for the rules from captured responses: headers and bodies, robots and sitemap files, link targets, probes, images, speed tests.

Captures are tables; each function turns one into facts of pages or sites, named as the rule table wants them. A
capture that is missing leaves its facts null, and their rules silent.
"""

from __future__ import annotations

import gzip
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelode.functions import urls
from sitelode.operators import captures
from sitelode.session import cut

#: Files that must not be public: path, what such a file begins with or holds. Fixed values.
PRIVATE_FILES = {"/.git/HEAD": r"^ref:\s|^[0-9a-f]{40}\s*$", "/.env": r"(?m)^[A-Z][A-Z0-9_]{2,}\s*=", "/.DS_Store": "^\\x00\\x00\\x00\\x01Bud1"}
#: Lighthouse audits whose failure is a finding: severity, title, category, impact, effort. Fixed values.
AUDITS = {
    "font-size": ("MEDIUM", "Text too small to read on mobile", "mobile", 3, 2),
    "tap-targets": ("MEDIUM", "Tap targets too small or too close together", "mobile", 3, 2),
    "crawlable-anchors": ("LOW", "Links not crawlable (no proper href)", "crawlability", 2, 2),
    "canonical": ("MEDIUM", "Invalid rel=canonical (Lighthouse)", "crawlability", 3, 1),
    "hreflang": ("LOW", "Invalid hreflang (Lighthouse)", "crawlability", 2, 1),
}
#: Measured metrics of real users: name and member of the payload. Fixed values.
FIELD_METRICS = {"LCP": "LARGEST_CONTENTFUL_PAINT_MS", "INP": "INTERACTION_TO_NEXT_PAINT", "CLS": "CUMULATIVE_LAYOUT_SHIFT_SCORE"}
#: How deep sitemap indexes are followed.
SITEMAP_DEPTH = 3


# -- pages ---------------------------------------------------------------------------------------------


def fetch_facts(pages: DataFrame) -> DataFrame:
    """Facts of each page's response (url, final_url, status, hops, headers map, body, elapsed_ms)."""
    own = lambda n: captures.header("headers", n)
    missing = captures.missing_headers(F.col("headers"))
    body = F.coalesce("body", F.lit(""))
    insecure = body.rlike(r"(?i)\bsrc\s*=\s*[\"']http://|<link\b[^>]*\bhref\s*=\s*[\"']http://")
    return pages.withColumns(
        {
            "scheme": urls.scheme("final_url"), "final_host": urls.strip_www(urls.host("final_url")), "final_path": urls.path("final_url"), "slug_path": urls.path("url"),
            "x_robots": own("x-robots-tag"), "content_encoding": own("content-encoding"), "csp": own("content-security-policy"), "cache_control": own("cache-control"),
            "missing_headers": F.size(missing), "csp_missing": F.array_contains(missing, "content-security-policy"), "mixed_content": insecure, "body_bytes": F.octet_length(body),
            "hops_trivial": F.when((F.col("hops") > 0) & urls.trivial_redirect("url", "final_url"), 1).otherwise(0), "own_host_final": urls.same_site("url", "final_url"),
        }
    )


def missing_by_order(pages: DataFrame, home: Column, order: list[str]) -> DataFrame:
    """is_home and seen_template: whether an earlier page of the site has the page's template and no share image either (needs site, template, has_share_image).

    The first such page of a template is found by a combined minimum and a join, so a large site is no single task.
    """
    p = pages.withColumn("is_home", home).withColumn("_bare", ~F.col("is_home") & ~F.coalesce("has_share_image", F.lit(False)))
    first = p.where("_bare").groupBy("site", "template").agg(F.min(F.struct(*order)).alias("_first"))
    return p.join(first, ["site", "template"], "left").withColumn("seen_template", F.coalesce(F.struct(*order) > F.col("_first"), F.lit(False)) & F.col("_bare")).drop("_bare", "_first")


def hreflang_facts(pages: DataFrame) -> DataFrame:
    """How many language links a page has, and whether one is its own address (needs ``doc`` and ``final_url``)."""
    links = F.filter("doc.link_tags", lambda x: F.lower(x["rel"]).contains("alternate") & (F.coalesce(x["hreflang"], F.lit("")) != ""))
    bare = lambda u: F.rtrim(F.regexp_replace(u, "#.*$", ""), F.lit("/"))
    absolute = lambda h: F.when(h.startswith("//"), F.concat(urls.scheme("final_url"), F.lit(":"), h)).when(h.startswith("/"), F.concat(urls.scheme("final_url"), F.lit("://"), urls.host("final_url"), h)).otherwise(h)
    return pages.withColumns({"hreflangs": F.size(links), "hreflang_self": F.exists(links, lambda x: bare(absolute(F.trim(x["href"]))) == bare(F.col("final_url")))})


def share_image_facts(pages: DataFrame, images: DataFrame) -> DataFrame:
    """What a page's share image answered and how large it is (pages: share_url; images: url, status, width, height)."""
    own = images.groupBy("url").agg(F.max(F.struct("status", "width", "height")).alias("_i"))
    met = pages.join(own, pages["share_url"] == own["url"], "left").drop(own["url"])
    return met.withColumns({"share_status": F.col("_i.status").cast("int"), "share_width": F.col("_i.width").cast("int"), "share_height": F.col("_i.height").cast("int")}).drop("_i")


def hero_facts(pages: DataFrame, images: DataFrame) -> DataFrame:
    """What the priority image of a page answered (pages: final_url, hero as an absolute URL; images: url, status, hops, bytes)."""
    own = images.groupBy("url").agg(F.max(F.struct("status", "hops", "bytes")).alias("_i"))
    met = pages.join(own, pages["hero"] == own["url"], "left").drop(own["url"])
    seen = {"hero_status": F.col("_i.status").cast("int"), "hero_hops": F.col("_i.hops").cast("int"), "hero_kb": F.expr("CAST(_i.bytes DIV 1024 AS INT)"), "hero_cross": F.when(F.col("_i").isNotNull(), ~urls.same_site("hero", "final_url"))}
    return met.withColumns(seen).drop("_i")


# -- sites ---------------------------------------------------------------------------------------------


def robots_facts(files: DataFrame) -> DataFrame:
    """Facts of robots files (site, status, content_type, text), one a site."""
    t = F.coalesce("text", F.lit(""))
    found = (F.col("status") == 200) & (F.trim(t) != "")
    base = files.select(
        "site", F.col("status").alias("robots_status"), F.octet_length(t).alias("robots_bytes"), found.alias("robots_found"), (found & (F.lower("content_type").contains("html") | F.ltrim(t).startswith("<"))).alias("robots_html"),
        F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), 1))).alias("robots_sitemaps"),
    )
    lines = files.where(found).select("site", F.posexplode(F.split(t, r"\r\n|\r|\n")).alias("seq", "line"))
    access = captures.robots_access(lines)
    star = captures.robots_access(lines, {"*": "all"}).where("blocked").select("site", F.lit(True).alias("blocks_all"))
    # Only groups of an agent's own count here; a block of all is a finding of its own.
    named = captures.robots_rules(lines).select("site", "agent").distinct()
    own = access.withColumn("key", F.lower("agent")).join(named.withColumnRenamed("agent", "key"), ["site", "key"], "left_semi")
    ai = own.groupBy("site").agg(F.count_if(F.col("blocked") & F.col("role").isin("search", "user")).cast("int").alias("ai_blocked_search"), F.count_if(F.col("blocked") & ~F.col("role").isin("search", "user")).cast("int").alias("ai_blocked_train"))
    return base.join(star, "site", "left").join(ai, "site", "left").fillna(False, ["blocks_all"])


def link_facts(targets: DataFrame, linked: DataFrame) -> DataFrame:
    """Facts of sampled link targets (site, url, final_url, status, hops, canonical, noindex, words, html) and of all internal links (site, url).

    A target can be moved and noindexed or non-canonical at once; broken ones are nothing else.
    """
    gone = F.col("status").isin(404, 410)
    alive = ~gone & (F.col("status") < 500)
    moved = alive & (F.col("hops") > 0)
    trivial = moved & urls.trivial_redirect("url", "final_url")
    page = alive & (F.col("status") == 200) & F.coalesce("html", F.lit(True))
    hidden = page & F.coalesce("noindex", F.lit(False))
    bare = lambda c: F.rtrim(urls.path(c), F.lit("/"))
    other = page & ~hidden & (F.coalesce("canonical", F.lit("")) != "") & urls.same_site("canonical", "url") & (bare("canonical") != bare("final_url"))
    t = targets.withColumns({"_other": other, "_key": F.rtrim("canonical", F.lit("/"))})
    known = linked.select("site", F.rtrim("url", F.lit("/")).alias("_key")).distinct().withColumn("_linked", F.lit(True))
    length = targets.where("status = 200").groupBy("site", F.rtrim("url", F.lit("/")).alias("_key")).agg(F.max("words").alias("_target_words"))
    met = t.join(known, ["site", "_key"], "left").join(length, ["site", "_key"], "left")
    count = lambda c, n: F.count_if(c).cast("int").alias(n)
    thin = F.col("_other") & (F.col("words") - F.col("_target_words") >= 150) & (F.col("_target_words") < F.col("words") * 0.75)
    return met.groupBy("site").agg(
        F.count("*").cast("int").alias("linked_sample"), count(gone, "links_broken"), count(~gone & (F.col("status") >= 500), "links_5xx"), count(moved & ~trivial, "links_redirect"), count(trivial, "links_trivial"),
        count(F.col("_other"), "links_noncanonical"), count(hidden, "links_noindex"), (~F.coalesce(F.bool_or(F.col("_other") & F.col("_linked")), F.lit(False))).alias("canonical_unlinked"), count(thin, "thinner_targets"),
    )


def exposed_facts(probes: DataFrame) -> DataFrame:
    """Private files that can be downloaded (site, path, status, content_type, body; path '' is the control, a name that can't exist)."""
    control = probes.where("path = ''").groupBy("site").agg(F.max(F.when(F.col("status") == 200, F.substring("body", 1, 2048))).alias("_control"))
    body = F.substring("body", 1, 2048)
    signed = F.lit(False)
    for path, form in PRIVATE_FILES.items():
        signed = signed | ((F.col("path") == path) & body.rlike(form))
    hit = (F.col("status") == 200) & ~F.lower(F.coalesce("content_type", F.lit(""))).contains("html") & ~F.lower(F.substring("body", 1, 300)).contains("<html") & signed & (F.col("_control").isNull() | (body != F.col("_control")))
    return probes.where("path <> ''").join(control, "site", "left").groupBy("site").agg(F.count_if(hit).cast("int").alias("exposed_files"))


def missing_page_facts(probes: DataFrame) -> DataFrame:
    """What a name that can't exist answers (site, home, status, final_url)."""
    return probes.select("site", F.col("status").alias("probe_status"), (F.rtrim("final_url", F.lit("/")) == F.rtrim("home", F.lit("/"))).alias("probe_to_home"))


def asset_facts(assets: DataFrame) -> DataFrame:
    """How many static files lack long-lived caching (site, cache_control): less than a day and not immutable."""
    c = F.lower(F.coalesce("cache_control", F.lit("")))
    age = F.regexp_extract(c, r"max-age=(\d+)", 1).try_cast("bigint")
    fresh = c.contains("immutable") | (F.coalesce(age, F.lit(0)) >= 86400)
    return assets.groupBy("site").agg(F.count("*").cast("int").alias("assets"), F.count_if(~fresh).cast("int").alias("stale_assets"))


def domain_facts(records: DataFrame, now: Column) -> DataFrame:
    """Days until a domain's registration ends (site, payload: a registration record as JSON)."""
    events = F.try_variant_get(F.try_parse_json("payload"), "$.events", "array<struct<eventAction:string,eventDate:string>>")
    ends = F.filter(events, lambda e: e["eventAction"] == "expiration")
    until = F.try_to_timestamp(F.get(ends, F.lit(0))["eventDate"])
    return records.select("site", captures.days_left(until, now).alias("domain_days"))


def contact_facts(addresses: DataFrame, answers: DataFrame) -> DataFrame:
    """Published addresses whose domain can't receive mail (addresses: site, email; answers: domain, has_mx, has_a; unknown ones tell nothing)."""
    own = addresses.select("site", F.lower(F.regexp_extract("email", "@(.+)$", 1)).alias("domain")).where("domain <> ''").distinct()
    dead = ~F.col("has_mx") & ~F.col("has_a")
    return own.join(answers, "domain", "left").groupBy("site").agg(F.count_if(F.coalesce(dead, F.lit(False))).cast("int").alias("contact_dead"))


def social_image_facts(images: DataFrame) -> DataFrame:
    """Size and shape of each site's share image and icon (site, kind 'og' or 'favicon', status, bytes, width, height); only loaded ones tell."""
    ok = F.col("status") == 200
    of = lambda kind, value: F.max(F.when(ok & (F.col("kind") == kind), value))
    return images.groupBy("site").agg(of("og", F.col("bytes")).cast("int").alias("og_bytes"), of("favicon", F.col("bytes")).cast("int").alias("favicon_bytes"), of("og", F.when(F.col("height") > 0, F.col("width") / F.col("height"))).alias("og_ratio"))


def llms_link_facts(links: DataFrame, targets: DataFrame) -> DataFrame:
    """Dead and non-canonical links of a site's llms.txt (links: site, links array; targets: url, status, canonical); links that weren't captured tell nothing."""
    each = links.select("site", F.explode("links").alias("url")).distinct()
    known = targets.groupBy("url").agg(F.max(F.struct("status", "canonical")).alias("_t"))
    met = each.join(known, "url")
    dead = F.col("_t.status") >= 400
    other = ~dead & (F.coalesce("_t.canonical", F.lit("")) != "") & (urls.norm_url("_t.canonical") != urls.norm_url("url"))
    return met.groupBy("site").agg(F.count_if(dead).cast("int").alias("llms_dead"), F.count_if(F.coalesce(other, F.lit(False))).cast("int").alias("llms_noncanonical"))


def duplicate_facts(sites: DataFrame, pairs: DataFrame, medians: DataFrame) -> DataFrame:
    """near_pairs and median_unique of each site: its pairs of near-duplicates, and the least of its groups' medians of words of their own (site; site, ...; site, median_own)."""
    n = pairs.groupBy("site").agg(F.count("*").cast("int").alias("near_pairs"))
    low = medians.groupBy("site").agg(F.min("median_own").cast("int").alias("median_unique"))
    return sites.select("site").distinct().join(n, "site", "left").join(low, "site", "left").withColumn("near_pairs", F.coalesce("near_pairs", F.lit(0)))


def small_image_facts(images: DataFrame) -> DataFrame:
    """Images shown at 160 pixels or less: how many a site has, how many were measured, how many of those are heavy, and their mean size (site, width, status, bytes)."""
    small = images.where("width <= 160")
    checked = F.col("status") == 200
    heavy = checked & (F.col("bytes") > 25 * 1024)
    return small.groupBy("site").agg(F.count("*").cast("int").alias("small_imgs"), F.count_if(checked).cast("int").alias("small_checked"), F.count_if(heavy).cast("int").alias("small_heavy"))


# -- speed tests -----------------------------------------------------------------------------------------


def speed_findings(results: DataFrame) -> DataFrame:
    """site, severity, category, impact, effort, title of speed-test payloads (site, payload JSON): failed audits, the three largest savings, real users' metrics."""
    v = F.try_parse_json("payload")
    field = lambda p, t="string": F.try_variant_get(F.col("v"), p, t)
    row = lambda s, t, c, i, e: F.struct(s.alias("severity"), F.lit(c).alias("category"), F.lit(i).alias("impact"), F.lit(e).alias("effort"), t.alias("title"))
    failed = [F.when(field(f"$.lighthouseResult.audits['{a}'].score", "double") == 0, row(F.lit(s), F.lit(t), c, i, e)) for a, (s, t, c, i, e) in AUDITS.items()]
    users = []
    for name, member in FIELD_METRICS.items():
        level, there = field(f"$.loadingExperience.metrics.{member}.category"), field(f"$.loadingExperience.metrics.{member}.percentile", "double").isNotNull()
        users.append(F.when(there & (level == "SLOW"), row(F.lit("HIGH"), F.lit(f"{name} fails Core Web Vitals (real users)"), "performance", 4, 4)).when(there & (level == "AVERAGE"), row(F.lit("MEDIUM"), F.lit(f"{name} needs improvement (real users)"), "performance", 3, 3)))
    audits = F.map_values(F.coalesce(field("$.lighthouseResult.audits", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    get = lambda a, p, t="string": F.try_variant_get(a, p, t)
    saves = F.filter(audits, lambda a: (get(a, "$.details.type") == "opportunity") & (get(a, "$.details.overallSavingsMs", "double") >= 300) & (get(a, "$.score", "double").isNull() | (get(a, "$.score", "double") < 0.9)))
    ranked = F.reverse(F.array_sort(F.transform(saves, lambda a: F.struct(get(a, "$.details.overallSavingsMs", "double").alias("ms"), F.coalesce(get(a, "$.title"), F.lit("opportunity")).alias("title")))))
    chances = F.transform(F.slice(ranked, 1, 3), lambda x: row(F.lit("INFO"), F.concat(F.lit("Speed opportunity: "), x["title"]), "performance", 3, 3))
    found = F.concat(F.array_compact(F.array(*failed, *users)), chances)
    return results.select("site", v.alias("v")).select("site", F.explode(found).alias("x")).select("site", "x.*")


# -- sitemaps --------------------------------------------------------------------------------------------


def decoded(body: Column) -> Column:
    """The text of a captured body, unpacked if it is gzip or deflate; bad packing leaves it as it is."""

    @F.pandas_udf("string")
    def text(col):
        def one(b):
            if b is None:
                return None
            b = bytes(b)
            try:
                b = gzip.decompress(b) if b[:2] == b"\x1f\x8b" else zlib.decompress(b) if b[:1] == b"\x78" else b
            except (OSError, EOFError, zlib.error):
                pass
            return b.decode("utf-8", "replace")

        return col.map(one)

    return text(body)


def sitemap_urls(files: DataFrame, roots: DataFrame, body: str = "body") -> DataFrame:
    """Every URL entry that a site's sitemaps reach: site, file, seq, loc, lastmod.

    ``files`` has site, url and body (binary, maybe packed) of captured sitemap files, ``roots`` site and url of those
    to begin with. Indexes are followed ``SITEMAP_DEPTH`` deep, each file counts once; files that weren't captured lead nowhere.
    """
    parsed = cut(files.select("site", "url", decoded(F.col(body)).alias("text")), "sitemaps")
    index = F.lower(F.substring("text", 1, 4000)).contains("<sitemapindex")
    loc = F.regexp_extract_all("text", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1)
    edges = cut(parsed.where(index).select("site", "url", F.explode(F.array_distinct(loc)).alias("child")), "sitemap-edges")
    reached = level = roots.select("site", "url").distinct()
    for _ in range(SITEMAP_DEPTH):
        level = level.join(edges, ["site", "url"]).select("site", F.col("child").alias("url")).distinct()
        reached = reached.unionByName(level)
    pages = parsed.where(~index).join(reached.distinct(), ["site", "url"], "left_semi").withColumnRenamed("url", "file")
    return captures.sitemap_entries(pages, "text").where("loc <> ''")
