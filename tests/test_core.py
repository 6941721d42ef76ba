from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sitelode.functions import text, urls
from sitelode.operators import captures, compare, console, near, rules, sampling, scoring
from sitelode.plans import serp, texts
from sitelode.sources import html, serp_payloads


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items()))
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "url,template", [("https://x.test/", "/"), ("https://x.test/a", "/*"), ("https://x.test/a/", "/*/"), ("https://x.test/blog/a/b?q=1", "/blog/*/*"), ("https://x.test/2024/a", "/{year}/*"), ("https://x.test", "/")]
)
def test_url_template(spark, url, template):
    assert one(spark, urls.url_template("u"), u=url) == template


@pytest.mark.parametrize("value,domain", [(" WWW.Ex.com:80/a ", "ex.com"), ("https://u:p@www.ex.co.uk/x?y", "ex.co.uk"), ("", ""), (None, ""), (".ex.com.", "ex.com")])
def test_normalize_domain(spark, value, domain):
    assert one(spark, urls.normalize_domain("v"), v=value) == domain


def test_csp(spark):
    allows = lambda src, script: one(spark, urls.csp_allows(F.split(F.lit(src), " "), F.lit(script), F.lit("https://x.test/p")), d="")
    assert allows("'self' https:", "https://cdn.test/a.js") and allows("*.cdn.test", "https://a.cdn.test/b.js")
    assert not allows("*.cdn.test", "https://cdn.test/b.js") and not allows("'self'", "https://a.x.test/b.js")


def test_affiliates(spark):
    kinds = {"https://www.amazon.com/dp/1?tag=a": "Amazon tag=", "https://go.awin1.com/x": "go.awin1.com", "https://x.test/?a=1&irclickid=9": "affiliate click id", "https://x.test/?tag=1": ""}
    for url, kind in kinds.items():
        assert one(spark, urls.affiliate_kind("u"), u=url) == kind


def test_keyphrases_and_shingles(spark):
    assert one(spark, text.keyphrases("t"), t="The ghost tour of 2024 ghost") == ["ghost", "tour", "ghost", "ghost tour", "2024 ghost"]
    assert one(spark, F.size(text.shingles("t")), t="a b c d e") == 0 and one(spark, text.shingles("t"), t="a b c d e f") == ["a b c d e f"]


def test_spread(spark):
    got = spark.range(10).select(F.col("id").alias("i")).where(sampling.spread(F.col("i"), F.lit(10), F.lit(3))).collect()
    assert sorted(r["i"] for r in got) == [0, 3, 6]
    for n in range(1, 20):
        for k in range(1, n + 1):
            want = {int(x * (n / k)) for x in range(k)}
            assert len(want) == k


def test_stratified_sample_is_the_procedure(spark):
    rows = [("s", "/blog/*", i) for i in range(10)] + [("s", "/news/*", 10), ("s", "/*", 11)]
    got = sampling.stratified(spark.createDataFrame(rows, "site string, template string, id int"), ["site"], "template", ["id"], 5)
    assert sorted(r["id"] for r in got.collect()) == [0, 3, 6, 10, 11]


def found(spark, rows):
    return spark.createDataFrame([("s", c, t, s, i, 2, 3) for i, (c, t, s) in enumerate(rows)], "site string, category string, title string, severity string, ord int, effort int, impact int")


def test_scores(spark):
    five = scoring.category_scores(found(spark, [("trust", f"t{i}", "HIGH") for i in range(5)]))
    assert five.first()["score"] == 20 and scoring.overall_scores(five).first()["overall"] == 92
    mixed = scoring.category_scores(found(spark, [("trust", "a", "CRITICAL"), ("trust", "b", "HIGH"), ("trust", "c", "MEDIUM"), ("trust", "d", "LOW")]))
    assert mixed.first()["score"] == 30
    first = scoring.category_scores(found(spark, [("trust", "a", "LOW"), ("trust", "a", "CRITICAL")]))
    assert first.first()["score"] == 96  # the first finding of a title counts, not the worst


def test_sweep_softens_rare_kinds(spark):
    rows = found(spark, [("trust", "a", "HIGH")]).withColumns({"url": F.lit("u"), "template": F.lit("/")})
    assert scoring.sweep_summary(rows, spark.createDataFrame([("s", 40)], "site string, n_pages int")).first()["severity"] == "MEDIUM"


def test_rules_fire_on_facts_and_not_without(spark):
    page = spark.createDataFrame([(1, 200, "", "d" * 100, 500, "https"), (2, 0, "", "", 0, "http")], "page_id int, status int, title string, description string, words int, scheme string")
    got = {(r["page_id"], r["title"]) for r in rules.findings(page, rules.P, ["page_id"]).collect()}
    assert (1, "Missing title tag") in got and {t for p, t in got if p == 2} == {"Page unreachable"}
    assert rules.findings(spark.createDataFrame([("s",)], "site string"), rules.S, ["site"]).count() == 0
    site = spark.createDataFrame([("s", 3, 40, 20)], "site string, links_broken int, linked_sample int, cert_days int")
    assert {r["title"] for r in rules.findings(site, rules.S, ["site"]).collect()} == {"Broken internal links (3 of 40 sampled)", "TLS certificate expires within 30 days"}


def test_robots(spark):
    lines = ["User-agent: a", "User-agent: GPTBot # x", "Disallow: /", "", "User-agent: *", "Disallow: /*", "Allow: /", "user-agent: ClaudeBot", "Disallow:"]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "site string, seq int, line string")
    got = {r["agent"]: r["blocked"] for r in captures.robots_access(df).collect()}
    assert got["GPTBot"] and not got["ClaudeBot"] and not got["PerplexityBot"]


def test_sitemap_entries(spark):
    xml = "<urlset><url><loc> https://x.test/a </loc><lastmod>2024-05-01T00:00</lastmod></url><URL><loc><![CDATA[https://x.test/b]]></loc></URL></urlset>"
    got = [(r["loc"], r["lastmod"]) for r in captures.sitemap_entries(spark.createDataFrame([("s", xml)], "site string, body string"), "body").orderBy("seq").collect()]
    assert got == [("https://x.test/a", "2024-05-01"), ("https://x.test/b", None)]


def test_agents_links_mail_and_days(spark):
    probes = spark.createDataFrame([("s", "A", "search", 1, 200, False), ("s", "A", "search", 2, 403, False), ("s", "B", "train", 1, 402, False)], "site string, agent string, role string, url_no int, status int, mitigated boolean")
    assert {r["agent"]: r["verdict"] for r in captures.agent_verdicts(probes).collect()} == {"A": "refused on some pages", "B": "pay per crawl"}
    links = spark.createDataFrame([("s", "http://x.test/a", "https://x.test/a/", 200, 1, "", False), ("s", "https://x.test/b", "https://x.test/b", 404, 0, "", False)], "site string, url string, final_url string, status int, hops int, canonical string, noindex boolean")
    assert {r["kind"] for r in captures.classify_links(links).collect()} == {"trivial redirect", "broken"}
    mail = spark.createDataFrame([("s", "spf", ["v=spf1 -all"]), ("s", "dmarc", []), ("t", "spf", None)], "site string, kind string, answers array<string>")
    assert {r["site"]: r["missing_mail_auth"] for r in captures.mail_facts(mail).collect()} == {"s": "DMARC", "t": ""}
    days = spark.createDataFrame([(datetime(2024, 1, 1), datetime(2024, 1, 1, 6))], "a timestamp, b timestamp")
    assert days.select(captures.days_left(F.col("a"), F.col("b")).alias("x")).first()["x"] == -1


def test_headers(spark):
    df = spark.sql("select map('Content-Security-Policy', 'x', 'Referrer-Policy', 'y') h")
    assert df.select(captures.header(F.col("h"), "content-security-policy").alias("x")).first()["x"] == "x"
    assert len(df.select(captures.missing_headers(F.col("h")).alias("x")).first()["x"]) == 4


def test_classes(spark):
    cases = {"booking.rivaltours.com": "business", "viator.com": "marketplace", "my-yelp.com": "marketplace", "x.com": "social", "azdailysun.com": "news", "goodtimestours.com": "business", "downtownflagstaffghosttours.com": "business", "visitx.com": "directory", "a.org": "directory", "b.edu": "reference"}
    df = spark.createDataFrame([(d,) for d in cases], "d string")
    assert {r["d"]: r["c"] for r in df.select("d", serp.classify(F.col("d")).alias("c")).collect()} == cases


def test_tally_and_top(spark):
    rows = [(1, 1, "q1", "https://www.rival.com/a", "rival.com", 2, 1), (1, 2, "q1", "https://rival.com/b", "www.rival.com", 5, 2), (1, 3, "q1", "https://rival.com/b#x", "rival.com", 9, 3), (2, 4, "Q2", "https://rival.com/c", "rival.com", 5, 1)]
    df = spark.createDataFrame(rows, "serp_id int, organic_id int, query string, url string, domain string, position int, seq int")
    r = serp.tally_domains(serp.organic_top(df)).first()
    assert (r["n_queries"], r["appearances"], r["best_pos"], r["avg_pos"], round(r["score"], 6)) == (2, 3, 2, 4.0, 0.9)
    assert serp.organic_top(df.limit(0)).count() == 0


def test_near_duplicates_match_brute_force(spark):
    import random

    random.seed(4)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(40):
        words = list(random.choice([base, base[::-1]]))
        for _ in range(random.randint(0, 3)):
            words[random.randrange(60)] = f"z{random.randrange(5)}"
        docs.append(("g", i, [" ".join(words[j : j + 6]) for j in range(55)]))
    df = spark.createDataFrame(docs, "g string, id int, s array<string>")
    _, reps = near.classes(df, ["g"], "id", "s")
    got = {(r["a"], r["b"]) for r in near.similar_classes(reps, ["g"], 0.8).collect()}
    sets, seen = {}, {}
    for _, i, s in docs:
        if frozenset(s) not in seen:
            seen[frozenset(s)] = i
            sets[i] = set(s)
    assert got == {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}


def test_prominence_drops_parts_of_better_phrases(spark):
    z = spark.createDataFrame([("s", "title", "1", "Ghost tour"), ("s", "body", "1", "ghost tour ghost tour parking")], "site string, zone string, instance string, text string")
    kept = [r["term"] for r in texts.prominence(z).orderBy("place").collect()]
    assert kept[0] == "ghost tour" and "ghost" not in kept and "tour" not in kept
    top = texts.prominence(z).orderBy("place").first()
    assert top["prominence"] == 100 and "title" in top["zones"]


def test_html(spark):
    assert html.parse("<p>tail &am")["visible_text"] in ("tail", "")
    assert html.parse("foo<b>bar</b>")["word_count"] == 2 and html.parse("<head><title>x")["word_count"] == 0 and html.parse(None)["word_count"] == 0
    assert html.structured(['{"@type": 3}', "", "{bad", '[{"@type":["A","B"]}]']) == (["A", "B"], 2, 1)
    assert html.image_size(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (640).to_bytes(4) + (480).to_bytes(4)) == (640, 480) and html.image_size(b"") is None
    assert html.normalize("https://x.test/a/", "../b#c") == "https://x.test/b" and not html.is_result_url("https://x.test/a.css")
    df = spark.createDataFrame([(1, "<a href='/b'>x</a>", "https://x.test/"), (2, None, None)], "doc int, html string, url string")
    parsed = html.parse_html(df, "html")
    assert parsed.columns == ["doc", "url", "_doc"] and parsed.count() == 2


def test_payload_formats():
    assert serp_payloads.detect({"organic_results": []}) == "serpapi" and serp_payloads.detect([{"tasks": []}]) == "list" and serp_payloads.detect(7) == "foreign"
    rows = list(serp_payloads.rows_of({"tasks": [{"data": {"keyword": "k"}, "result": [{"items": [{"type": "organic", "url": "https://www.a.test/", "rank_group": "3"}, None, {"type": "local_pack", "title": "t", "rating": {"value": 4.5, "votes_count": 2}}]}]}]}))
    assert rows == [("organic", "k", None, 3, "https://www.a.test/", "a.test", None, None, None), ("local", "k", None, None, None, "", "t", 4.5, 2)]


def test_compare(spark):
    s = spark.createDataFrame([("g", "a", "c", 80), ("g", "b", "c", 90), ("g", "d", "c", 80)], "feed string, site string, category string, score int")
    assert {r["site"]: (r["gap"], r["rank"]) for r in compare.category_gaps(s, ["feed"]).collect()} == {"a": (-10, 2), "b": (10, 1), "d": (-10, 2)}
    f = spark.createDataFrame([("a", "c", "Missing 3 x", "LOW", 1), ("b", "c", "Missing 4 x", "HIGH", 2), ("b", "c", "other", "LOW", 1)], "site string, category string, title string, severity string, count int")
    mine, theirs = compare.unique_findings(f, "a")
    assert mine.count() == 0 and [r["key"] for r in theirs.collect()] == ["other"]
    feats = spark.createDataFrame([("a", "x", False), ("a", "y", None), ("b", "x", True), ("b", "y", True)], "site string, feature string, present boolean")
    assert [r["feature"] for r in compare.advantages(feats, "a").collect()] == ["x"]


def test_console(spark):
    rows = [("p", "retention", True, '{"eventDataRetention":"TWO_MONTHS"}'), ("p", "key_events", True, '{"keyEvents":[{"eventName":"purchase"}]}'), ("p", "sitemaps", True, '{"sitemap":[]}'), ("q", "retention", True, '{"eventDataRetention":"FOURTEEN_MONTHS"}')]
    got = console.evaluate(spark.createDataFrame(rows, "property string, name string, ok boolean, body string"), F.lit("2024-05-01").cast("date")).collect()
    assert {(r["property"], r["title"]) for r in got} == {("p", "GA4 event data retention is TWO_MONTHS"), ("p", "No GA4 key event for leads"), ("p", "No sitemap submitted to Search Console")}
    props = spark.createDataFrame([("https://x.test/",), ("sc-domain:x.test",), ("sc-domain:a.x.test",)], "property string")
    assert console.pick_search_property(props, "a.x.test").first()["property"] == "sc-domain:x.test"


def test_scratch_tables_have_an_owner(spark, tmp_path):
    import glob

    from sitelode import session

    at = lambda: set(glob.glob(f"{session.shared_dir(spark)}/sitelode/*"))
    outside = session.cut(spark.range(3), "outside")
    before = at()
    with session.scratch():
        session.cut(spark.range(5), "inside").write.parquet(f"{tmp_path}/out")
        assert len(at() - before) == 1
    assert at() == before and outside.count() == 3 and spark.read.parquet(f"{tmp_path}/out").count() == 5
