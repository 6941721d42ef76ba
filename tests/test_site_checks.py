from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sitelode.operators import reports, rules, site_checks
from sitelode.sources import html
from sitelode.streaming import tally

HOME = """<html lang="en"><head><title>Book a tour</title><meta property="og:title" content="t"><meta property="og:image" content="i">
<script src="https://cdn.test/a.js"></script><link rel="stylesheet" href="/a.css">
<script type="application/ld+json">{"@type":"Organization","name":"X","url":"https://x.test/","aggregateRating":{"ratingValue":5},"sameAs":["https://www.facebook.com/xtours"]}</script></head>
<body><h1>x</h1><a href="tel:1">call</a><a href="/privacy">p</a><a href="https://instagram.com/xtours">i</a><img src="a.jpg" loading="lazy" srcset="b.jpg 100w, c.jpg 800w">12 Main Street, X LLC</body></html>"""
POST = """<html><head><title>p</title><script type="application/ld+json">{"@type":"BlogPosting","headline":"h","author":{"name":"n"}}</script>
<script type="application/ld+json">{"@type":["Dentist"],"telephone":"1","address":"a"}</script></head><body>Last updated in May 2024</body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame([(1, "s", "https://x.test/", HOME, True, "script-src 'self'", ""), (2, "s", "https://x.test/blog/p", POST, False, None, "max-snippet:20")], "page_id int, site string, url string, html string, is_home boolean, csp string, x_robots string")
    parsed = html.page_facts(html.parse_html(df, "html"))
    return site_checks.with_nodes(html.absolute_links(parsed, "url", "doc.links").withColumn("links", F.col("doc.links"))).cache()


def by_id(df, *cols):
    return {r["page_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_schema_depth(pages):
    got = by_id(site_checks.schema_facts(pages), "article_node", "article_complete", "self_serving", "org_thin")
    assert got == {1: (False, None, True, True), 2: (True, False, False, False)}


def test_snippets_policy_hero_and_social(pages):
    assert by_id(site_checks.snippet_facts(pages), "max_snippet", "nosnippet", "dated") == {1: (None, False, False), 2: (20, False, True)}
    assert by_id(site_checks.policy_facts(pages), "csp_blocks", "third_party_before_css") == {1: (True, True), 2: (None, False)}
    assert by_id(site_checks.hero_image(pages), "hero", "hero_lazy")[1] == ("c.jpg", True)
    assert by_id(site_checks.social_facts(pages), "og_image", "og_complete", "title_cta")[1] == (True, False, True)


def test_site_facts(pages):
    trust = site_checks.trust_facts(pages).first()
    assert trust["contact_route"] and trust["missing_trust"] == "about, terms"
    facts = site_checks.transparency_facts(pages).first()
    assert facts["postal_found"] and facts["legal_named"]
    assert {(r["platform"], r["declared"]) for r in site_checks.footprint(pages).collect()} == {("Facebook", True), ("Instagram", False)}
    assert site_checks.local_nodes(pages).first()["types"] == ["Dentist"]


def test_rules_over_parsed_pages(pages):
    full = site_checks.policy_facts(site_checks.snippet_facts(site_checks.schema_facts(pages))).withColumns({"status": F.lit(200), "scheme": F.lit("https")})
    got = {(r["page_id"], r["title"]) for r in rules.findings(full, rules.P, ["page_id"]).collect()}
    assert {(1, "Self-serving review markup on the business's own entity"), (1, "Content-Security-Policy blocks a script the page loads"), (2, "Article schema is missing recommended properties"), (2, "Missing html lang attribute"), (2, "Snippet length is tightly capped")} <= got


def test_analytics(spark):
    df = spark.createDataFrame([("s", "gtag('x', 'G-ABCDEFGH12')"), ("t", "'UA-12345-1'"), ("u", "/assets/G-ABCDEFGH.js umami ramen")], "site string, html string")
    assert {r["site"]: (r["analytics"], r["ua_only"]) for r in site_checks.analytics_found(df).collect()} == {"s": (1, 0), "t": (1, 1), "u": (0, 0)}


def test_signals_llms_security_heads_and_owned(spark):
    r = site_checks.signal_facts(spark.createDataFrame([("s", "# BEGIN Cloudflare managed content\nContent-Signal: search=yes, ai-train=no", "ai-input=no")], "site string, text string, header string")).first()
    assert not r["signal_search_no"] and r["signal_input_no"] and r["cdn_managed"]
    llms = spark.createDataFrame([("s", "# T\n> sum\n- [a](https://x.test/a)", "text/plain"), ("t", "hello", "text/html")], "site string, text string, content_type string")
    assert {x["site"]: x["llms_format"] for x in site_checks.llms_facts(llms).collect()} == {"s": True, "t": False}
    assert site_checks.security_txt_facts(spark.createDataFrame([("s", "Contact: x\nExpires: 2024-01-01T00:00")], "site string, text string")).first()["security_expires"] == "2024-01-01"
    heads = spark.createDataFrame([("s", "u", "GET", 200), ("s", "u", "HEAD", 405), ("s", "v", "GET", 200)], "site string, url string, method string, status int")
    assert site_checks.head_failures(heads).first()["head_failures"] == 1
    homes = spark.createDataFrame([("s", ["G-1"], ["x"])], "site string, ids array<string>, names array<string>")
    others = spark.createDataFrame([("s", "a.test", 200, False, ["G-1"], [], [], 0), ("s", "b.test", 200, True, [], ["x"], ["dir"], 0), ("s", "c.test", 404, True, ["G-1"], ["x"], [], 0)], "site string, domain string, status int, declared boolean, ids array<string>, names array<string>, site_names array<string>, depth int")
    assert tuple(site_checks.owned_domains(homes, others).first()) == ("s", 1, 1)


def test_local_types(spark):
    cases = {"Dentist": True, "TaxiService": False, "CarRepair": True, "Repair": False, "Service": False, "Thing": False, "petStore": False}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r["t"]: r["x"] for r in df.select("t", site_checks.local_type(F.col("t")).alias("x")).collect()} == cases


def test_report_tables(spark):
    df = spark.createDataFrame([("a|b", 1), (None, 2)], "t string, n int")
    assert reports.markdown_table(df, ["t", "n"]).splitlines()[2:] == ["| a\\|b | 1 |", "|  | 2 |"] and "<td>a|b</td>" in reports.html_table(df, ["t", "n"])


def test_stream_of_results(spark, tmp_path):
    rows = [(1, "A.test", 1, datetime(2024, 1, 1, 5)), (1, "A.test", 1, datetime(2024, 1, 1, 5)), (2, "a.test", 2, datetime(2024, 1, 1, 9)), (3, "b.test", 1, datetime(2024, 2, 1))]
    df = spark.createDataFrame(rows, "organic_id long, domain string, position int, captured_at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = tally.domain_windows(tally.read_results(spark, str(tmp_path / "in"), df.schema), late="7 days")
    tally.write(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = {(r["domain"], r["appearances"], r["score"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert ("a.test", 2, 1.5) in got
