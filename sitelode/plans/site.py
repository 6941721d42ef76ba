"""Plans over payloads, captures and audit reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.functions import text, urls
from sitelode.operators import captures, compare, console, rules
from sitelode.sources import html, serp_payloads
from sitelode.session import table

_LESS = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captured pages written as HTML documents."""
    p = table(spark, sf_dir, "pages")
    attr = lambda c: F.replace(_LESS(c), F.lit('"'), F.lit("&quot;"))
    heads = F.array_join(F.transform(F.coalesce("h1", F.array().cast("array<string>")), lambda h: F.concat(F.lit("<h1>"), _LESS(h), F.lit("</h1>"))), "")
    types = F.to_json(F.struct(F.filter("schema_types", lambda t: t.isNotNull()).alias("@type")))
    ld = F.when(F.size("schema_types") > 0, F.concat(F.lit('<script type="application/ld+json">'), types, F.lit("</script>"))).otherwise("")
    robots = F.when(F.col("robots").isNotNull(), F.concat(F.lit('<meta name="robots" content="'), attr(F.col("robots")), F.lit('">'))).otherwise("")
    doc = F.concat(
        F.lit('<!doctype html><html lang="'), attr(F.col("lang")), F.lit('"><head><title>'), _LESS(F.col("title")), F.lit('</title><meta name="description" content="'), attr(F.col("description")), F.lit('">'), robots,
        F.lit('<link rel="canonical" href="'), attr(F.col("canonical")), F.lit('">'), ld, F.lit("</head><body>"), heads, F.lit("<p>"), _LESS(F.col("description")), F.lit("</p></body></html>"),
    )
    return p.select("page_id", "url", "status", doc.alias("html"))


def html_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as HTML and parsed again."""
    f = html.page_facts(html.parse_html(_documents(spark, sf_dir), "html"))
    return f.select("page_id", "title", "description", "lang", "h1_count", "meta_robots", "words", "jsonld_blocks", F.size("doc.jsonld_types").alias("n_types"), F.coalesce("canonical", F.lit("")).alias("canonical"))


def html_rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page rules over parsed documents."""
    f = html.page_facts(html.parse_html(_documents(spark, sf_dir), "html")).withColumn("scheme", urls.scheme("url"))
    return rules.findings(f, rules.P, ["page_id"]).select("page_id", "severity", "category", "title")


def serp_payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported result pages as flat rows; unreadable payloads as errors."""
    return serp_payloads.flat_rows(table(spark, sf_dir, "serp_raw"), "raw_id", "payload")


def serp_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each domain appears in each kind of feature, and for how many queries."""
    rows = serp_payload_rows(spark, sf_dir).where("kind like 'feature:%' and domain <> ''")
    return rows.groupBy("domain", F.regexp_replace("kind", "^feature:", "").alias("feature")).agg(F.count("*").alias("n"), F.count_distinct(F.lower("query")).alias("n_queries"))


def _robots_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robots files derived from nations: one site each, with lines that vary by its number."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("site"), F.col("n_nationkey").alias("k"))
    lines = [
        (1, F.lit("# robots")), (2, F.when(F.col("k") % 2 == 0, "User-agent: *").otherwise("User-Agent: GPTBot")), (3, F.when(F.col("k") % 5 == 0, "User-agent: ClaudeBot").otherwise("")), (4, F.when(F.col("k") % 3 == 0, "Disallow: /").otherwise("Disallow: /private")),
        (5, F.when(F.col("k") % 6 == 0, "Allow: /").otherwise("Disallow:")), (6, F.lit("Sitemap: https://x.test/s.xml")), (7, F.when(F.col("k") % 4 == 0, "user-agent: PerplexityBot # bot").otherwise("")), (8, F.when(F.col("k") % 7 == 0, "Disallow: /*").otherwise("Disallow: /tmp")),
    ]
    return n.select("site", F.explode(F.array(*(F.struct(F.lit(i).alias("seq"), c.alias("line")) for i, c in lines))).alias("x")).select("site", "x.*").where("line <> ''")


def robots_root_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.robots_access(_robots_lines(spark, sf_dir))


def sitemap_lastmod(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemap dates of sites derived from orders: a customer's orders are its URLs."""
    o = table(spark, sf_dir, "orders")
    day = F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return captures.sitemap_facts(o.select(F.col("o_custkey").alias("site"), F.col("o_orderkey").alias("loc"), day.alias("lastmod")), "1996-06-01")


def canonical_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose canonical is another captured page of the site, with the words of both; words that are lost mark a thinner target."""
    p = table(spark, sf_dir, "pages").where("url is not null").select("page_id", F.col("word_count").alias("words"), urls.norm_url("url").alias("k"), urls.norm_url("canonical").alias("c"), "canonical")
    source = p.where("canonical is not null and c <> k and c <> ''").select("page_id", "words", "c")
    target = p.groupBy("k").agg(F.max("words").alias("target_words"))
    return source.join(target, source["c"] == target["k"]).select("page_id", "words", "target_words", ((F.col("words") - F.col("target_words") >= 150) & (F.col("target_words") < F.col("words") * 0.75)).alias("thinner"))


def affiliate_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of pages with affiliate links; every line item is a link of its supplier's page."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("site"), F.col("l_orderkey").alias("page_id"), F.lit(200).alias("status"), "l_partkey")
    k = F.col("l_partkey")
    link = (
        F.when(k % 7 == 0, F.concat(F.lit("https://www.amazon.test/dp/"), k, F.lit("?tag=x"))).when(k % 7 == 1, F.lit("https://www.awin1.com/c?m=1")).when(k % 7 == 2, F.concat(F.lit("https://shop.test/?irclickid="), k))
        .when(k % 7 == 3, F.concat(F.lit("https://www.viator.com/x?pid=P"), k)).otherwise(F.concat(F.lit("https://plain.test/"), k))
    )
    return captures.affiliate_facts(l.withColumn("url", link))


def _report_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category scores of the last readable report of each site in each feed."""
    r = table(spark, sf_dir, "audit_reports").withColumn("v", F.try_parse_json("payload"))
    got = r.select("feed", urls.normalize_domain("domain").alias("site"), "file_no", "report_id", F.try_variant_get("v", "$.scores", "map<string,int>").alias("scores")).where("scores is not null and site <> ''")
    last = got.groupBy("feed", "site").agg(F.max_by("scores", F.struct("file_no", "report_id")).alias("scores"))
    return last.select("feed", "site", F.explode("scores").alias("category", "score")).where("score is not null")


def category_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each site's scores against the best other site of its feed."""
    return compare.category_gaps(_report_scores(spark, sf_dir), ["feed"])


def unique_report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of site findings of a feed that only one of its sites has."""
    r = table(spark, sf_dir, "audit_reports").withColumn("v", F.try_parse_json("payload"))
    f = r.select("feed", urls.normalize_domain("domain").alias("site"), F.explode(F.try_variant_get("v", "$.site_findings", "array<struct<severity:string,title:string,category:string>>")).alias("x")).select("feed", "site", "x.*")
    kinds = f.groupBy("feed", "category", text.finding_key("title").alias("key")).agg(F.count_distinct("site").alias("n_sites"), F.min("site").alias("site"))
    return kinds.where("n_sites = 1").select("feed", "category", "key", "site")


def period_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and views of two windows of 30 days, by user."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), (F.col("event_type") == "click").cast("long").alias("clicks"), (F.col("event_type") == "view").cast("long").alias("impressions"))
    return console.period_compare(e, ["user_id"], F.col("day"), F.lit("2024-01-31").cast("date"), 15)


def host_variant_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results on another host or scheme than https and the bare domain, as impressions."""
    o = table(spark, sf_dir, "serp_organic").where("url is not null and domain is not null and trim(domain) <> ''")
    rows = o.select(F.col("url").alias("page"), F.concat(F.lit("https://"), urls.normalize_domain("domain")).alias("s"), F.lit(1).alias("impressions"))
    return console.host_variant_impressions(rows, F.col("s"))


QUERIES = {
    f.__name__: f
    for f in (html_round_trip, html_rule_findings, serp_payload_rows, serp_features, robots_root_access, sitemap_lastmod, canonical_links, affiliate_share, category_gaps, unique_report_findings, period_compare, host_variant_impressions)
}

_ND = r"regexp_replace(regexp_replace(regexp_extract(lower(regexp_replace(domain, '^[\s ]+|[\s ]+$', '', 'g')), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:@]*)', 1), '^\.+|\.+$', '', 'g'), '^www\.', '')"
_HOST = r"coalesce(lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '')"
_PATH = r"coalesce(regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), '')"
_NORM = r"lower(regexp_replace(" + _HOST + r", '^www\.', '') || rtrim(" + _PATH + ", '/'))"
_SPACED = r"list_filter(regexp_split_to_array({0}, '[\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+'), lambda x: x <> '')"
_AGENTS = ",".join(f"('{a}','{r}')" for a, r in captures.ROBOT_ROLES.items())
SQL = {
    "html_round_trip": f"""SELECT page_id, array_to_string({_SPACED.format("coalesce(title, '')")}, ' ') AS title, trim(coalesce(description, '')) AS description, coalesce(lang, '') AS lang, coalesce(len(h1), 0) AS h1_count, coalesce(robots, '') AS meta_robots,
CAST(coalesce(len(list_concat(flatten(list_transform(h1, lambda h: {_SPACED.format("coalesce(h, '')")})), {_SPACED.format("coalesce(description, '')")})), len({_SPACED.format("coalesce(description, '')")})) AS INTEGER) AS words,
CASE WHEN len(schema_types) > 0 THEN 1 ELSE 0 END AS jsonld_blocks, CAST(coalesce(len(list_distinct(list_filter(schema_types, lambda t: t IS NOT NULL))), 0) AS INTEGER) AS n_types, coalesce(canonical, '') AS canonical FROM pages""",
    "robots_root_access": f"""WITH n AS (SELECT n_name AS site, n_nationkey AS k FROM nation), a(agent, role) AS (VALUES {_AGENTS}),
first_agents AS (SELECT site, k, unnest(list_concat([CASE WHEN k % 2 = 0 THEN '*' ELSE 'gptbot' END], CASE WHEN k % 5 = 0 THEN ['claudebot'] ELSE [] END)) AS agent FROM n),
r AS (SELECT site, agent, p[1] AS al, p[2] AS path FROM (SELECT site, agent, unnest(list_concat([['d', CASE WHEN k % 3 = 0 THEN '/' ELSE '/private' END]], CASE WHEN k % 6 = 0 THEN [['a', '/']] ELSE [] END, CASE WHEN k % 4 <> 0 THEN [['d', CASE WHEN k % 7 = 0 THEN '/*' ELSE '/tmp' END]] ELSE [] END)) AS p FROM first_agents)
UNION ALL SELECT site, 'perplexitybot', 'd', CASE WHEN k % 7 = 0 THEN '/*' ELSE '/tmp' END FROM n WHERE k % 4 = 0),
v AS (SELECT site, agent, bool_or(al = 'd' AND rtrim(path, '*') = '/') AND NOT bool_or(al = 'a' AND rtrim(path, '*') = '/') AS blocked FROM r GROUP BY 1, 2)
SELECT n.site, a.agent, a.role, coalesce(m.blocked, s.blocked, false) AS blocked FROM n CROSS JOIN a LEFT JOIN v m ON m.site = n.site AND m.agent = lower(a.agent) LEFT JOIN v s ON s.site = n.site AND s.agent = '*'""",
    "sitemap_lastmod": """SELECT o_custkey AS site, CAST(count(*) AS INTEGER) AS sitemap_urls, CAST(count(d) AS INTEGER) AS sitemap_with_lastmod, CAST(count(DISTINCT d) AS INTEGER) AS sitemap_lastmods, CAST(count(*) FILTER (d > '1996-06-01') AS INTEGER) AS sitemap_future, true AS sitemap_found
FROM (SELECT o_custkey, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders) GROUP BY 1""",
    "canonical_links": f"""WITH p AS (SELECT page_id, word_count AS words, {_NORM.format('url')} AS k, CASE WHEN canonical IS NOT NULL THEN {_NORM.format('canonical')} END AS c FROM pages WHERE url IS NOT NULL), t AS (SELECT k, max(words) AS target_words FROM p GROUP BY 1)
SELECT page_id, words, target_words, words - target_words >= 150 AND target_words < words * 0.75 AS thinner FROM p JOIN t ON p.c = t.k WHERE p.c <> p.k AND p.c <> ''""",
    "affiliate_share": """WITH l AS (SELECT l_suppkey AS site, l_orderkey AS page_id, CASE l_partkey % 7 WHEN 0 THEN 'a' || l_partkey WHEN 1 THEN 'n' WHEN 2 THEN 'i' || l_partkey WHEN 3 THEN 'v' || l_partkey END AS u FROM lineitem),
t AS (SELECT site, count(DISTINCT page_id) AS analysed FROM l GROUP BY 1), k AS (SELECT DISTINCT * FROM l WHERE u IS NOT NULL), p AS (SELECT site, u FROM k JOIN t USING (site) GROUP BY site, u, analysed HAVING count(*) <= analysed * 0.5)
SELECT site, CAST(analysed AS INTEGER) AS analysed, CAST((SELECT count(DISTINCT page_id) FROM k JOIN p USING (site, u) WHERE k.site = t.site) AS INTEGER) AS affiliate_pages FROM t""",
    "period_compare": """SELECT user_id, CAST(sum(CASE WHEN n AND event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks, CAST(sum(CASE WHEN NOT n AND event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks_before, CAST(sum(CASE WHEN n AND event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS impressions,
CAST(sum(CASE WHEN NOT n AND event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS impressions_before FROM (SELECT *, CAST(ts AS DATE) >= DATE '2024-01-16' AS n FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-30') GROUP BY 1""",
    "host_variant_impressions": rf"""WITH o AS (SELECT coalesce(lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)), '') AS scheme, {_HOST.format('url')} AS host, 'https://' || {_ND} AS site FROM serp_organic WHERE url IS NOT NULL AND domain IS NOT NULL AND trim(domain) <> '')
SELECT site, scheme, host, count(*) AS impressions FROM o WHERE host <> {_HOST.format('site')} OR scheme <> 'https' GROUP BY ALL""",
    "category_gaps": f"""WITH r AS (SELECT feed, {_ND} AS site, file_no, report_id, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS v FROM audit_reports),
l AS (SELECT feed, site, last(v->'$.scores' ORDER BY file_no, report_id) AS s FROM r WHERE json_type(v->'$.scores') = 'OBJECT' AND site <> '' GROUP BY 1, 2),
e AS (SELECT feed, site, k AS category, TRY_CAST(json_extract_string(s, '$."' || k || '"') AS INTEGER) AS score FROM (SELECT feed, site, s, unnest(json_keys(s)) AS k FROM l)), x AS (SELECT * FROM e WHERE score IS NOT NULL),
y AS (SELECT *, (SELECT max(o.score) FROM x o WHERE o.feed = x.feed AND o.category = x.category AND o.site <> x.site) AS best_rival, rank() OVER (PARTITION BY feed, category ORDER BY score DESC) AS rank FROM x)
SELECT feed, site, category, score, best_rival, score - best_rival AS gap, rank FROM y""",
    "unique_report_findings": f"""WITH r AS (SELECT feed, {_ND} AS site, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS v FROM audit_reports), f AS (SELECT feed, site, unnest(from_json(v->'$.site_findings', '["JSON"]')) AS x FROM r WHERE json_type(v->'$.site_findings') = 'ARRAY'),
k AS (SELECT feed, x->>'$.category' AS category, regexp_replace(x->>'$.title', '[0-9]+(?:\\.[0-9]+)?', '#', 'g') AS key, site FROM f)
SELECT feed, category, key, min(site) AS site FROM k GROUP BY 1, 2, 3 HAVING count(DISTINCT site) = 1""",
}
