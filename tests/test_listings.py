"""Result pages as HTML, and the small relational steps of an audit."""

import json

from pyspark.sql import functions as F

from sitelode.operators import listings
from sitelode.sources import html, result_pages

PAGE = """<html><a href="https://search.brave.com/x">engine</a>
<section id="mixed-top"><div id="llm-snippet"><a href="https://ai.test/a?x=1#y">AI <b>source</b></a><a href="https://ai.test/a?x=1">again</a><div data-type="web"><a href="https://inner.test">no block of its own</a></div></div></section>
<section id="mixed-main"><div data-type="web" data-pos="3"><img><a href="https://static.test/logo.png">logo</a><a href="https://one.test/p/"> link <i>text</i></a><div class="search-snippet-title" title=" One
 title "></div></div>
<div class="snippet"><a href="https://card.test/">Card</a></div><div class="snippet" id="x"><a href="https://plain.test/">no block</a></div>
<div data-type="web"><a href="https://one.test/p">same</a></div><div data-type="web" data-pos="x"><a href="http://two.test/">Two</a><span class="title"></span></div>
<div data-type="ad" data-landing-page="https://ad.test/l" data-headline-text=" Buy  now "><a href="https://click.test/">x</a></div>
<div data-type="cluster"><div class="video-cluster-2"></div><a href="https://v.test/1">V</a></div>
<div id="locations"><ul><li><div class="title">Cafe <b>A</b></div><div class="rating">4.5 stars</div><div class="review-count">(1,234)</div><ul><li><div class="title">inner</div></li></ul></li><li><div class="rating">3</div></li><li><div class="title">B</div></ul></div></section>
<div class="snippet"><a href="https://outside.test/">outside the main results</a></div><div id="pagination-snippet"><a href="https://next.test/">next</a></div>"""


def test_result_pages(spark):
    rows = [(1, PAGE), (2, '<a href="https://a.test/x">A</a><a href="https://a.test/x/">B</a><a href="/rel">r</a><a href="https://maps.google.com/z">m</a><b><a href="https://c.test/?q=1">C'), (3, 'var c={page:"/captcha"}'), (4, None), (5, "")]
    got = result_pages.flat_rows(spark.createDataFrame(rows, "id int, html string").withColumn("kind", F.lit("clash")), "id", "html").orderBy("id", "seq").collect()
    assert [(r["id"], r["kind"], r["position"], r["url"], r["domain"], r["title"], r["slot"], r["rating"], r["reviews"]) for r in got if r["id"] == 1] == [
        (1, "organic", 1, "https://one.test/p/", "one.test", "One title", 3, None, None), (1, "organic", 2, "http://two.test/", "two.test", "Two", None, None, None), (1, "local", 1, None, "", "Cafe A", None, 4.5, 1234), (1, "local", 2, None, "", "B", None, None, None),
        (1, "feature:ai_answer", None, "https://ai.test/a?x=1#y", "ai.test", "AI source", None, None, None), (1, "feature:ai_answer", None, "https://inner.test", "inner.test", "no block of its own", None, None, None), (1, "feature:entity", None, "https://card.test/", "card.test", "Card", None, None, None),
        (1, "feature:ad", None, "https://ad.test/l", "ad.test", "Buy now", None, None, None), (1, "feature:video", None, "https://v.test/1", "v.test", "V", None, None, None),
    ]
    assert [(r["parse_mode"], r["position"], r["url"], r["title"]) for r in got if r["id"] == 2] == [("fallback", 1, "https://a.test/x", "A"), ("fallback", 2, "https://c.test/?q=1", "C")]
    assert [r["kind"] for r in got if r["id"] > 2] == ["challenge"]


def test_captures_and_lists(spark):
    bot = spark.createDataFrame([("a", 403, "x"), ("b", 429, "x"), ("c", 200, "x"), ("d", 500, "x")], "url string, status int, body string")
    browser = spark.createDataFrame([("a", 200, "y"), ("b", 403, "y"), ("c", 200, "y"), ("d", 200, "y")], "url string, status int, body string")
    assert sorted(map(tuple, listings.with_fallback(bot, browser).collect())) == [("a", 200, "y", True), ("b", 429, "x", False), ("c", 200, "x", False), ("d", 500, "x", False)]
    listed = spark.createDataFrame([("s", "u", 1), ("s", "v", 2)], "site string, url string, ord int")
    assert {r["url"]: r["status"] for r in listings.crawled(listed, spark.createDataFrame([("u", 200)], "url string, status int")).collect()} == {"u": 200, "v": 0}
    links = spark.createDataFrame([("s", "u/", 1), ("s", "w", 3), ("s", "w/", 2), ("t", "u", 4)], "site string, url string, ord int")
    assert sorted(map(tuple, listings.uncrawled(links, listed).select("site", "url", "ord").collect())) == [("s", "w/", 2), ("t", "u", 4)]
    lines = spark.createDataFrame([("s", 1, "User-agent: GPTBot"), ("s", 2, "Disallow: /x")], "site string, seq int, line string")
    verdicts = spark.createDataFrame([("s", "gptbot", "ok"), ("s", "CCBot", "ok"), ("t", "GPTBot", "ok")], "site string, agent string, verdict string")
    assert [r["agent"] for r in listings.named_agents(verdicts, lines).collect()] == ["gptbot"]
    images = spark.createDataFrame([("s", "https://s/a/2.png", 2), ("s", "https://s/a/1.png", 1), ("s", "https://s/m/3.png", 3)], "site string, url string, ord int")
    assert sorted(r["url"] for r in listings.image_sample(images).collect()) == ["https://s/a/1.png", "https://s/m/3.png"]
    fonts = spark.createDataFrame([("s", "f", 200, 90_000), ("s", "f", 200, 90_000), ("s", "g", 200, 90_000), ("s", "h", 404, 9)], "site string, url string, status int, bytes int")
    assert [tuple(r) for r in listings.font_payload(fonts).collect()] == [("s", 175, 2)]


def test_values(spark):
    values = [None, "", "(min-width: 600px)", "(MAX-WIDTH:30em)", "(max-width: 20em)", "screen and (min-width:1px) and (max-width: 500px)", "print"]
    df = spark.createDataFrame([(v,) for v in values], "m string")
    assert [r[0] for r in df.select(listings.media_matches(F.col("m"))).collect()] == [True, True, False, True, False, True, True]
    df = spark.createDataFrame([("",), ("max-age=63072000; includeSubDomains",), ("max-age=60",), ("junk",)], "h string")
    assert [r[0] for r in df.select(listings.hsts_quality(F.col("h"))).collect()] == [None, "strong", "max-age under 6 months, no includeSubDomains", "max-age under 6 months, no includeSubDomains"]
    nodes = [{"address": {"streetAddress": "1 A St", "postalCode": "9", "addressCountry": ""}, "aggregateRating": {"ratingValue": 4.5, "ratingCount": 7}}, {"address": "plain", "aggregateRating": {"ratingValue": "5"}}, {}]
    df = spark.createDataFrame([(json.dumps(n),) for n in nodes], "n string")
    assert [tuple(r) for r in df.select(listings.address_text(F.col("n")), listings.rating_text(F.col("n"))).collect()] == [("1 A St, 9", "4.5 from 7 reviews"), ("plain", "5"), ("", None)]
    errors = [{"error": {"message": "X has not been used in project 1. Enable https://console.developers.google.com/apis/api/x/overview?project=1.", "status": "PERMISSION_DENIED"}}, {"error": {"message": " m ", "details": [{"reason": "A"}, {"x": 1}, {"reason": "B", "metadata": {"activationUrl": "u"}}]}}, {"raw": "oops"}]
    df = spark.createDataFrame([(json.dumps(e),) for e in errors], "b string")
    got = [tuple(r[0]) for r in df.select(listings.api_error(F.col("b"))).collect()]
    assert [(g[1], g[2], g[3]) for g in got] == [("PERMISSION_DENIED", "SERVICE_DISABLED", "https://console.developers.google.com/apis/api/x/overview?project=1"), (None, "B", "u"), (None, None, None)] and got[2][0] == "oops"
    assert html.schema_text(['{"@type":"T","name":"N","url":"u","x":[{"about":"a b","link":"https://z"}],"n":1}', "broken"]) == "N a b"
    assert html.srcset_candidates("a,b.png\t1x,\n data:image/png;base64,xx 2x, c.webp  800w") == [("a,b.png", "1x"), ("c.webp", "800w")] and [html.srcset_weight(d) for d in ("", "2x", "800w", "1.5x")] == [1000, 2000, 800, 1500]


def test_summaries_and_orders(spark):
    pages = spark.createDataFrame([("a", 200, "crawl"), ("a", 200, "sweep"), ("b", 0, "crawl"), ("b", 200, "sweep"), ("c", 200, "crawl"), ("d", 404, "crawl"), ("d", 404, "sweep"), ("d", 200, "crawl"), ("d", 500, "crawl")], "site string, status int, source string")
    psi = spark.createDataFrame([("a", "ok"), ("b", "ok"), ("c", "ok"), ("d", "ok")], "site string, psi_status string")
    got = {r["site"]: r["confidence"] for r in listings.confidence(pages, psi, spark.createDataFrame([("c",)], "site string")).collect()}
    assert got == {"a": "high", "b": "low", "c": "medium", "d": "low"} and {r["confidence"] for r in listings.confidence(pages, psi.where("site = 'x'")).where("site = 'a'").collect()} == {"medium"}
    doc = '<html><body><h2>How to get there?</h2><h3>Fares</h3><ul></ul><table></table><script type="application/ld+json">{"@type":["WebSite","Hotel","Bar","Cafe","Zoo"],"datePublished":"x"}</script></body></html>'
    page = html.page_facts(html.parse_html(spark.createDataFrame([("u", doc)], "url string, html string"), "html"))
    assert tuple(listings.answer_readiness(page).drop("words").first()) == ("u", 1, 2, 1, 1, "schema only", "Bar, Cafe, Hotel, Zoo")
    terms = spark.createDataFrame([("s", 1, "boat tours", ["title"], 0), ("s", 2, "sunset", ["body"], 3), ("s", 3, "harbour walk", ["body", "h1"], 9)], "site string, place int, term string, zones array<string>, body_count int")
    assert tuple(listings.keyword_insights(terms).first()) == ("s", False, ["h1"], ["sunset"], ["boat tours", "harbour walk"])
    f = spark.createDataFrame([("LOW", 5, 1), ("HIGH", 2, 2), ("HIGH", 4, 3), ("INFO", 1, 4)], "severity string, impact int, ord int")
    assert [r["ord"] for r in listings.ordered_findings(f).collect()] == [3, 2, 1, 4]
    features = spark.createDataFrame([("a", "ad", 1), ("b", "ad", 3), ("a", "video", 4)], "domain string, feature string, n int")
    assert [(r["domain"], r["feature"]) for r in listings.ordered_features(features).collect()] == [("a", "ad"), ("a", "video"), ("b", "ad")]
    cells = spark.createDataFrame([("x", "a", "1"), ("x", "b", "2"), ("y", "a", "3")], "feature string, site string, value string")
    assert sorted(map(tuple, listings.feature_matrix(cells, ["a", "b"]).collect())) == [("x", "1", "2"), ("y", "3", None)]
    rows = spark.createDataFrame([("q", 5, 1), ("r", 5, 2), ("s", 9, 0)], "query string, impressions int, clicks int")
    assert [r["query"] for r in listings.ordered_search_rows(rows).collect()] == ["s", "r", "q"]
    domains = spark.createDataFrame([("s", "z.test", True), ("s", "a.test", False), ("s", "b.test", False), ("s", "a.test", False)], "site string, domain string, declared boolean")
    assert [r["domain"] for r in listings.owned_candidates(domains, 2).orderBy("place").collect()] == ["z.test", "a.test"]
