"""Facts from captures, and audit reports side by side, on small captures with the quirks of real ones."""

import gzip
import json
import zlib

from pyspark.sql import functions as F

from sitelode.operators import captures, probe_facts, report_features, rules
from sitelode.sources import html


def one(df, **where):
    for k, v in where.items():
        df = df.where(F.col(k) == v)
    (row,) = df.collect()
    return row.asDict(recursive=True)


def titles(df, scope):
    return {r["title"] for r in rules.findings(df, scope, ["site"]).collect()}


def test_headers_and_bodies(spark):
    rows = [
        ("a", "http://a.test/X_y", "https://www.a.test/X_y", 200, 1, {"X-Robots-Tag": "NoIndex", "Content-Security-Policy": "default-src 'self'", "Cache-Control": "no-store"}, "<img src='http://b.test/i.png'>" + "é" * 20_000, 4100.0),
        ("b", "https://b.test/", "https://b.test/new", 200, 2, {h: "x" for h in captures.SECURITY_HEADERS} | {"content-encoding": "br"}, None, 10.0),
    ]
    df = probe_facts.fetch_facts(spark.createDataFrame(rows, "site string, url string, final_url string, status int, hops int, headers map<string,string>, body string, elapsed_ms double"))
    a, b = one(df, site="a"), one(df, site="b")
    assert (a["x_robots"], a["missing_headers"], a["csp_missing"], a["mixed_content"], a["body_bytes"], a["hops_trivial"]) == ("NoIndex", 5, False, True, 40_031, 1)
    assert (b["missing_headers"], b["mixed_content"], b["hops_trivial"], b["body_bytes"], b["own_host_final"]) == (0, False, 0, 0, True)
    assert {"Noindexed via X-Robots-Tag header", "Mixed content on an HTTPS page", "Missing 5 security header(s)", "HTML served without compression", "Slow server response", "HTML is served Cache-Control: no-store", "URL slug not clean"} <= titles(df.where("site = 'a'"), rules.P)
    assert titles(df.where("site = 'b'"), rules.P) & {"Server ignores Accept-Encoding", "Redirect chain (2 hops)"} == {"Server ignores Accept-Encoding", "Redirect chain (2 hops)"}


def test_hreflang_and_share_images_by_template(spark):
    doc = '<link rel="alternate" hreflang="de" href="/de/"><link rel="ALTERNATE" hreflang="en" href="{}"><link rel="alternate" type="x" href="/feed">'
    pages = spark.createDataFrame([("a", "https://a.test/en/", doc.format("https://a.test/en")), ("a", "https://a.test/x", doc.format("/en/"))], "site string, final_url string, html string")
    got = {r["final_url"]: (r["hreflangs"], r["hreflang_self"]) for r in probe_facts.hreflang_facts(html.parse_html(pages, "html")).collect()}
    assert got == {"https://a.test/en/": (2, True), "https://a.test/x": (2, False)}
    rows = [(1, "a", "/t/*", False, "i1"), (2, "a", "/t/*", False, None), (3, "a", "/", False, None), (4, "a", "/t/*", True, "gone"), (5, "b", "/t/*", False, None)]
    p = spark.createDataFrame(rows, "page_id int, site string, template string, has_share_image boolean, share_url string")
    seen = {r["page_id"]: (r["is_home"], r["seen_template"]) for r in probe_facts.missing_by_order(p, F.col("page_id") == 3, ["page_id"]).collect()}
    assert seen == {1: (False, False), 2: (False, True), 3: (True, False), 4: (False, False), 5: (False, False)}
    images = spark.createDataFrame([("i1", 200, 300, 300), ("gone", 404, None, None), ("i1", 200, 300, 300)], "url string, status int, width int, height int")
    got = {r["page_id"]: (r["share_status"], r["share_width"]) for r in probe_facts.share_image_facts(p, images).collect()}
    assert got == {1: (200, 300), 2: (None, None), 3: (None, None), 4: (404, None), 5: (None, None)}


def test_robots_files(spark):
    rows = [
        ("all", 200, "text/plain", "User-agent: *\nDisallow: /\nSitemap: https://x/s.xml\nsitemap: https://x/s.xml"), ("some", 200, "text/plain", "User-agent: GPTBot\r\nUser-agent: OAI-SearchBot\r\nDisallow: /\r\n"), ("train", 200, "text/plain", "User-agent: CCBot\nDisallow: /"),
        ("html", 200, "text/html", "<html></html>"), ("none", 404, "text/plain", "gone"), ("down", 503, None, None),
    ]
    df = probe_facts.robots_facts(spark.createDataFrame(rows, "site string, status int, content_type string, text string")).withColumn("sitemap_found", F.lit(True))
    by = {r[0]: titles(df.where(F.col("site") == r[0]), rules.S) for r in rows}
    assert by["all"] == {"robots.txt blocks all crawlers"} and by["some"] == {"robots.txt blocks AI search crawlers", "Sitemap not referenced in robots.txt"} and "robots.txt blocks AI training crawlers" in by["train"]
    assert "robots.txt is an HTML page" in by["html"] and by["none"] == {"robots.txt not found"} and by["down"] == {"robots.txt returns a server error"}


def test_link_architecture(spark):
    u = lambda i: f"https://a.test/p/{i}"
    rows = [("a", u(1), u(1), 404, 0, "", False, 0, True), ("a", u(2), u(2), 503, 0, "", False, 0, True), ("a", u(3), u(3) + "/", 200, 1, "", True, 9, True), ("a", u(4), "https://a.test/q/4", 200, 1, "", False, 9, True)]
    rows += [("a", u(i), u(i), 200, 0, "https://a.test/c/1", False, 900, True) for i in (5, 6, 7)] + [("a", "https://a.test/c/1", "https://a.test/c/1", 200, 0, "", False, 100, True), ("a", u(8) + "?v=1", u(8) + "?v=1", 200, 0, u(8), False, 9, True), ("a", u(9), u(9), 200, 0, "https://b.test/", False, 9, True)]
    targets = spark.createDataFrame(rows, "site string, url string, final_url string, status int, hops int, canonical string, noindex boolean, words int, html boolean")
    linked = spark.createDataFrame([("a", u(5))], "site string, url string")
    got = one(probe_facts.link_facts(targets, linked))
    assert got == {"site": "a", "linked_sample": 10, "links_broken": 1, "links_5xx": 1, "links_redirect": 1, "links_trivial": 1, "links_noncanonical": 3, "links_noindex": 1, "canonical_unlinked": True, "thinner_targets": 3}
    found = titles(probe_facts.link_facts(targets, linked), rules.S)
    assert {"Broken internal links (1 of 10 sampled)", "Internal links point at non-canonical URLs", "Canonical points at a thinner page than the one carrying it"} <= found
    assert not one(probe_facts.link_facts(targets, linked.union(spark.createDataFrame([("a", "https://a.test/c/1/")], "site string, url string"))))["canonical_unlinked"]


def test_private_files_and_missing_pages(spark):
    ref, env = "ref: refs/heads/main\n", "SECRET_KEY = x\n"
    rows = [("open", "/.git/HEAD", 200, "text/plain", ref), ("open", "/.env", 200, None, env), ("open", "", 404, "text/html", "no"), ("same", "/.git/HEAD", 200, "text/plain", ref), ("same", "", 200, "text/plain", ref), ("page", "/.env", 200, "text/html", env), ("page", "/.git/HEAD", 200, "text/plain", "<html>ref: "), ("shut", "/.env", 403, "text/plain", env)]
    got = {r["site"]: r["exposed_files"] for r in probe_facts.exposed_facts(spark.createDataFrame(rows, "site string, path string, status int, content_type string, body string")).collect()}
    assert got == {"open": 2, "same": 0, "page": 0, "shut": 0}
    probes = probe_facts.missing_page_facts(spark.createDataFrame([("a", "https://a.test/", 200, "https://a.test"), ("b", "https://b.test/", 200, "https://b.test/x9"), ("c", "https://c.test/", 404, "https://c.test/x9")], "site string, home string, status int, final_url string"))
    assert [titles(probes.where(F.col("site") == s), rules.S) for s in "abc"] == [{"Missing pages redirect to the homepage"}, {"Missing pages return HTTP 200 (soft 404)"}, set()]


def test_assets_domains_contacts_and_small_images(spark):
    assets = spark.createDataFrame([("a", "max-age=31536000"), ("a", "max-age=60"), ("b", None), ("b", "no-cache"), ("c", "immutable")], "site string, cache_control string")
    assert {r["site"]: (r["assets"], r["stale_assets"]) for r in probe_facts.asset_facts(assets).collect()} == {"a": (2, 1), "b": (2, 2), "c": (1, 0)}
    rdap = spark.createDataFrame([("a", json.dumps({"events": [{"eventAction": "registration", "eventDate": "2020-01-01T00:00:00Z"}, {"eventAction": "expiration", "eventDate": "2024-02-10T00:00:00Z"}]})), ("b", "broken")], "site string, payload string")
    got = {r["site"]: r["domain_days"] for r in probe_facts.domain_facts(rdap, F.lit("2024-01-31 12:00:00").cast("timestamp")).collect()}
    assert got == {"a": 9, "b": None}
    addresses = spark.createDataFrame([("a", "x@dead.test"), ("a", "y@DEAD.test"), ("a", "z@ok.test"), ("b", "w@unknown.test")], "site string, email string")
    answers = spark.createDataFrame([("dead.test", False, False), ("ok.test", False, True)], "domain string, has_mx boolean, has_a boolean")
    assert {r["site"]: r["contact_dead"] for r in probe_facts.contact_facts(addresses, answers).collect()} == {"a": 1, "b": 0}
    images = spark.createDataFrame([("a", 100, 200, 50_000)] * 2 + [("a", 60, 200, 900), ("a", 60, 404, None), ("a", 900, 200, 10**6)], "site string, width int, status int, bytes int")
    facts = probe_facts.small_image_facts(images)
    assert one(facts) == {"site": "a", "small_imgs": 4, "small_checked": 3, "small_heavy": 2} and titles(facts, rules.S) == {"Small images are served from large files"}


def test_speed_findings(spark):
    payload = {
        "lighthouseResult": {"audits": {"font-size": {"score": 0}, "canonical": {"score": 1}, **{f"o{i}": {"score": 0.5, "title": f"T{i}", "details": {"type": "opportunity", "overallSavingsMs": 100 * i}} for i in range(1, 7)}, "done": {"score": 0.95, "title": "D", "details": {"type": "opportunity", "overallSavingsMs": 9000}}}},
        "loadingExperience": {"metrics": {"LARGEST_CONTENTFUL_PAINT_MS": {"percentile": 4000, "category": "SLOW"}, "CUMULATIVE_LAYOUT_SHIFT_SCORE": {"percentile": 12, "category": "AVERAGE"}, "INTERACTION_TO_NEXT_PAINT": {"percentile": 90, "category": "FAST"}}},
    }
    df = spark.createDataFrame([("a", json.dumps(payload)), ("b", "{}"), ("c", "no")], "site string, payload string")
    assert sorted((r["site"], r["severity"], r["title"]) for r in probe_facts.speed_findings(df).collect()) == [
        ("a", "HIGH", "LCP fails Core Web Vitals (real users)"), ("a", "INFO", "Speed opportunity: T4"), ("a", "INFO", "Speed opportunity: T5"), ("a", "INFO", "Speed opportunity: T6"), ("a", "MEDIUM", "CLS needs improvement (real users)"), ("a", "MEDIUM", "Text too small to read on mobile"),
    ]


def test_sitemap_indexes(spark):
    index = lambda *xs: ("<?xml?><SITEMAPINDEX>" + "".join(f"<sitemap><loc> {x} </loc></sitemap>" for x in xs) + "</SITEMAPINDEX>").encode()
    urlset = lambda *xs: ("<urlset>" + "".join(f"<url><loc>{x}</loc><lastmod>2024-01-02T03:04</lastmod></url>" for x in xs) + "</urlset>").encode()
    files = [("a", "r", index("i", "g", "lost", "r")), ("a", "i", index("d")), ("a", "d", zlib.compress(urlset("u3"))), ("a", "g", gzip.compress(urlset("u1", "u2"))), ("a", "other", urlset("never")), ("b", "r", b"\x1f\x8bbroken"), ("b", "s", urlset("v"))]
    roots = [("a", "r"), ("b", "r"), ("b", "s")]
    got = probe_facts.sitemap_urls(spark.createDataFrame(files, "site string, url string, body binary"), spark.createDataFrame(roots, "site string, url string")).collect()
    assert sorted((r["site"], r["loc"], r["lastmod"]) for r in got) == [("a", "u1", "2024-01-02"), ("a", "u2", "2024-01-02"), ("a", "u3", "2024-01-02"), ("b", "v", "2024-01-02")]


REPORT = {
    "domain": "a.test", "robots_found": True, "sitemap_url_count": 1234, "page_count": 3, "sweep_count": "4",
    "pages": [{"source": "crawl", "schema_types": ["FAQPage"], "client_rendered": True, "findings": [{"title": "Title too long (80)", "category": "on page", "severity": "low"}]}, {"source": "homepage", "status": 200, "word_count": 1500, "title": "T", "description": "", "h1": ["A", " ", "B"], "schema_types": ["TravelAgency", "WebSite", "WebSite"]}, 7],
    "health": [["Analytics", "none detected"], ["Contact & trust pages", "phone · about ✓ privacy ✗"], ["Entity transparency", "could not tell"], ["TLS certificate", "valid, 41 days left"], ["llms.txt", "present"]],
    "ai_matrix": [{"agent": "X", "verdict": "ok"}, {"agent": "Y", "verdict": "refused (403) on some pages"}, {"agent": "Z", "verdict": "HTTP 500"}],
    "social": {"metrics": [["Image dimensions", "1200x630"]], "findings": [{"title": "Missing twitter:card", "category": "social", "severity": "LOW"}]}, "footprint": {"social": [{"url": "u", "platform": "p"}, {"url": "v"}], "sameas_present": False, "google": {"maps_links": ["m", "m"], "gbp_links": []}},
    "keywords": {"primary": "boat tours", "terms": [{"term": t} for t in ("a", "b", "", "c", "d", "e", "f")]}, "psi": {"status": "rate-limited", "findings": [{"title": "PSI", "category": "performance"}]},
    "site_findings": [{"title": "Broken internal links (3 of 40 sampled)", "category": "crawlability", "severity": "HIGH"}], "sweep_summary": [{"title": "Title too long (99)", "category": "on page", "severity": "MEDIUM", "count": 6}],
}


def reports(spark, *values):
    return spark.createDataFrame([("g", f"s{i}", json.dumps(v)) for i, v in enumerate(values)], "feed string, site string, payload string").withColumn("v", F.try_parse_json("payload"))


def test_features_of_reports(spark):
    rows = report_features.site_features(reports(spark, REPORT, {"domain": "b.test"}), ["site"]).collect()
    got = {r["feature"]: (r["value"], r["present"]) for r in rows if r["site"] == "s0"}
    assert got == {
        "robots_txt": ("yes", True), "sitemap": ("yes", True), "sitemap_urls": ("1,234", None), "jsonld_home": ("yes", True), "schema_home": ("TravelAgency, WebSite", None), "org_home": ("yes (TravelAgency)", True), "breadcrumb": ("no (0 of 2 pages)", False), "faq": ("yes (1 of 2 pages)", True),
        "analytics": ("no", False), "llms": ("yes", True), "contact": ("yes", True), "about": ("yes", True), "privacy": ("no", False), "terms": ("n/a", None), "postal": ("n/a", None), "legal": ("n/a", None), "hsts": ("no", False), "tls_days": ("41", None),
        "ai_edge": ("1 ok, 1 refused (Y), 1 not answered (Z)", False), "home_words": ("1,500", None), "home_title": ("T", True), "home_title_len": ("1 chars", None), "home_desc_len": ("none", False), "home_h1": ("A (+1 more)", True), "client_rendered": ("1 of 2", None),
        "og_image": ("yes (1200x630)", True), "social": ("2 (other, p)", True), "sameas": ("no", False), "google": ("yes (1 Maps, 0 Business Profile)", True), "kw_primary": ("boat tours", None), "kw_top5": ("a, b, c, d, e", None),
    }
    empty = {r["feature"]: (r["value"], r["present"]) for r in rows if r["site"] == "s1"}
    assert set(empty) == set(got) and {k: v for k, v in empty.items() if v != ("n/a", None)} == {"ai_edge": ("not tested", None)}


def test_findings_of_all_parts(spark):
    found = report_features.report_findings(reports(spark, REPORT), ["site"])
    assert {(r["part"], r["severity"], r["count"]) for r in found.collect()} == {("site-wide", "HIGH", 1), ("sweep", "MEDIUM", 6), ("social", "LOW", 1), ("page", "LOW", 1)}
    kinds = {(r["key"], r["severity"], r["part"], r["n"]) for r in report_features.finding_kinds(found, ["site"]).collect()}
    assert {k for k in kinds if k[0].startswith("Title")} == {("Title too long (#)", "MEDIUM", "sweep", 6), ("Title too long (#)", "MEDIUM", "page", 1)} and ("Broken internal links (# of # sampled)", "HIGH", "site-wide", 1) in kinds


def test_caveats(spark):
    r = lambda n, s, **x: {"page_count": n, "sitemap_found": s, **x}
    df = reports(spark, r(10, True), r(25, True, sweep_count=4), r(31, True), r(10, False), r(None, True), r(0, True), r(12, None))
    got = {x["site"]: (x["ratio"], x["over_limit"], x["caveat"]) for x in report_features.score_caveats(df, ["feed"], F.col("site") == "s0").collect()}
    assert got == {"s1": (2.9, False, False), "s2": (3.1, True, True), "s3": (1.0, False, True), "s4": (None, False, None), "s5": (None, True, True), "s6": (1.2, False, None)}


#: Facts that a fetch record states itself.
GIVEN = {"fetch_error", "elapsed_ms"}


def test_every_fact_has_a_producer():
    import glob
    from pathlib import Path

    root = Path(rules.__file__).parents[1]
    code = "".join(Path(f).read_text() for f in glob.glob(f"{root}/*/*.py") if not f.endswith("rules.py") and f"{root}/llm/" not in f)
    names = {n for facts in (rules.PAGE_FACTS, rules.SITE_FACTS) for own in facts.values() for n in own.split()}
    assert {n for n in names if f'"{n}"' not in code} == GIVEN


def test_images_of_pages_and_sites(spark):
    pages = spark.createDataFrame([("a", "https://a.test/", "https://cdn.test/h.jpg"), ("a", "https://a.test/2", "https://a.test/i.jpg"), ("a", "https://a.test/3", None)], "site string, final_url string, hero string")
    images = spark.createDataFrame([("https://cdn.test/h.jpg", 200, 1, 400_000), ("https://a.test/i.jpg", 404, 0, None)], "url string, status int, hops int, bytes int")
    got = {r["final_url"][-1]: (r["hero_status"], r["hero_hops"], r["hero_kb"], r["hero_cross"]) for r in probe_facts.hero_facts(pages, images).collect()}
    assert got == {"/": (200, 1, 390, True), "2": (404, 0, None, False), "3": (None, None, None, None)}
    social = spark.createDataFrame([("a", "og", 200, 700_000, 600, 600), ("a", "favicon", 200, 200_000, 32, 32), ("b", "og", 404, 9, 9, 9)], "site string, kind string, status int, bytes int, width int, height int")
    facts = probe_facts.social_image_facts(social)
    assert titles(facts.where("site = 'a'"), rules.S) == {"Share image is over 600 KB", "Favicon is 195 KB", "Aspect ratio 1.00:1 differs from the 1.91:1 social standard"} and not titles(facts.where("site = 'b'"), rules.S)


def test_links_of_llms_files_and_duplicates(spark):
    links = spark.createDataFrame([("a", ["https://a.test/1", "https://a.test/2", "https://a.test/3", "https://a.test/1"])], "site string, links array<string>")
    targets = spark.createDataFrame([("https://a.test/1", 404, None), ("https://a.test/2", 200, "https://a.test/x"), ("https://a.test/9", 500, None)], "url string, status int, canonical string")
    assert one(probe_facts.llms_link_facts(links, targets)) == {"site": "a", "llms_dead": 1, "llms_noncanonical": 1}
    sites = spark.createDataFrame([("a",), ("b",), ("c",)], "site string")
    facts = probe_facts.duplicate_facts(sites, spark.createDataFrame([("a", 1, 2)], "site string, a int, b int"), spark.createDataFrame([("a", 90), ("b", 100), ("b", 300)], "site string, median_own int"))
    assert {s: titles(facts.where(F.col("site") == s), rules.S) for s in "abc"} == {"a": {"Near-duplicate pages within a template"}, "b": {"Template pages are mostly boilerplate"}, "c": set()}


def test_local_and_social_presence(spark):
    from sitelode.operators import site_checks

    ld = json.dumps({"@type": "Restaurant", "name": "R", "telephone": "1", "address": "x", "url": "u"})
    rows = [("a", 1, f'<a href="tel:1">t</a><script type="application/ld+json">{ld}</script>'), ("b", 2, '<a href="https://www.google.com/maps/x">m</a>'), ("c", 3, "<p>none</p>")]
    pages = site_checks.with_nodes(html.parse_html(spark.createDataFrame(rows, "site string, page_id int, html string"), "html")).withColumn("links", F.col("doc.links"))
    facts = site_checks.local_facts(pages)
    assert {s: titles(facts.where(F.col("site") == s), rules.S) for s in "abc"} == {"a": {"LocalBusiness schema incomplete"}, "b": {"No LocalBusiness schema for a local business"}, "c": set()}
    profiles = spark.createDataFrame([("a", False), ("a", True), ("b", False)], "site string, declared boolean")
    assert {r["site"]: r["social_undeclared"] for r in site_checks.social_facts_of(profiles).collect()} == {"a": False, "b": True}
