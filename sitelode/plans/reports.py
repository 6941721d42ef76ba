"""Audit reports side by side: features, findings and caveats of the sites of a feed; findings on captured speed tests and consoles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.functions import urls
from sitelode.operators import captures, console, probe_facts, report_features, rules
from sitelode.plans.probes import _pick, _pick_sql, _targets
from sitelode.session import table


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last readable report of each site in each feed."""
    r = table(spark, sf_dir, "audit_reports").withColumn("v", F.try_parse_json("payload")).select("feed", urls.normalize_domain("domain").alias("site"), "file_no", "report_id", "v", "payload")
    read = r.where(F.schema_of_variant("v").startswith("OBJECT") & (F.col("site") != ""))
    last = read.groupBy("feed", "site").agg(F.max_by("payload", F.struct("file_no", "report_id")).alias("payload"))
    return last.select("feed", "site", F.parse_json("payload").alias("v"))


def report_site_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each site of a feed has or lacks, in 31 features."""
    return report_features.site_features(_reports(spark, sf_dir), ["feed", "site"])


def report_finding_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of findings of each site over all parts of its report."""
    return report_features.finding_kinds(report_features.report_findings(_reports(spark, sf_dir), ["feed", "site"]), ["feed", "site"])


def report_caveats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each site's score compares with that of the first site of its feed."""
    r = _reports(spark, sf_dir)
    first = r.groupBy("feed").agg(F.min("site").alias("first"))
    return report_features.score_caveats(r.join(first, "feed"), ["feed"], F.col("site") == F.col("first"))


def link_architecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on the links of sites; an order is a link target of its customer's site, and every third one is linked."""
    targets = _targets(spark, sf_dir).withColumns({"words": F.pmod(F.xxhash64("url"), F.lit(3)).cast("int") * 400, "html": F.lit(True)})
    linked = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("site"), F.concat(F.lit("https://s.test/p/"), "o_orderkey").alias("url"))
    return probe_facts.link_facts(targets, linked).drop("thinner_targets")


def robots_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on robots files; a nation is a site whose file depends on its number."""
    k = F.col("n_nationkey")
    text = _pick(k, ("User-agent: *\nDisallow: /", "User-agent: GPTBot\nUser-agent: PerplexityBot\nDisallow: /\nSitemap: https://x.test/s.xml", "User-agent: CCBot\nDisallow: /", "<html></html>", "", "User-agent: *\nAllow: /\nSitemap: https://x.test/s.xml"))
    files = table(spark, sf_dir, "nation").select(F.col("n_name").alias("site"), F.when(k % 7 == 6, 503).when(text == "", 404).otherwise(200).alias("status"), F.when(text.startswith("<"), "text/html").otherwise("text/plain").alias("content_type"), text.alias("text"))
    facts = probe_facts.robots_facts(files).withColumn("sitemap_found", F.lit(True))
    return rules.findings(facts, rules.S, ["site"]).select("site", "severity", "title")


def exposed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Private files that a supplier's site gives away; a third of the sites answer every name alike."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site"))
    ref = F.lit("ref: refs/heads/main")
    probes = s.select("site", F.explode(F.array(F.lit(""), F.lit("/.git/HEAD"), F.lit("/.env"))).alias("path"))
    body = F.when(F.col("path") == "/.env", F.when(F.col("site") % 5 == 0, "TOKEN=1").otherwise("nothing")).when(F.col("path") != "", ref).otherwise(F.when(F.col("site") % 3 == 0, ref).otherwise("not here"))
    status = F.when(F.col("path") == "", F.when(F.col("site") % 3 == 0, 200).otherwise(404)).when(F.col("site") % 4 == 0, 403).otherwise(200)
    return probe_facts.exposed_facts(probes.select("site", "path", status.alias("status"), F.lit("text/plain").alias("content_type"), body.alias("body")))


SPEEDS = (20, 49, 50, 89, 90, 100)
LEVELS = ("SLOW", "AVERAGE", "FAST")


def speed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of speed tests; a customer is a site whose result depends on its number."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site"))
    score, level = _pick(F.col("site"), SPEEDS), _pick(F.col("site"), LEVELS)
    payload = F.concat(F.lit('{"lighthouseResult":{"categories":{"performance":{"score":'), score / 100, F.lit('}},"audits":{"font-size":{"score":'), F.pmod("site", F.lit(2)), F.lit('}}},"loadingExperience":{"metrics":{"LARGEST_CONTENTFUL_PAINT_MS":{"percentile":3000,"category":"'), level, F.lit('"}}}}'))
    results = c.select("site", F.lit(200).alias("status"), payload.alias("payload"))
    scored = rules.findings(captures.speed_facts(results), rules.S, ["site"]).select("site", "severity", "title")
    return scored.unionByName(probe_facts.speed_findings(results).select("site", "severity", "title"))


def console_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on exported console settings; a supplier is a property whose items depend on its number."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("property"), F.col("s_suppkey").alias("k"))
    item = lambda name, ok, body: F.struct(F.lit(name).alias("name"), ok.alias("ok"), body.alias("body"))
    k, yes = F.col("k"), F.lit(True)
    rows = (
        item("retention", yes, F.concat(F.lit('{"eventDataRetention":"'), _pick(k, ("TWO_MONTHS", "FOURTEEN_MONTHS")), F.lit('"}'))), item("key_events", yes, F.when(k % 3 == 0, '{"keyEvents":[{"eventName":"purchase"}]}').otherwise('{"keyEvents":[{"eventName":"lead"}]}')),
        item("sitemaps", yes, F.when(k % 5 == 0, '{"sitemap":[]}').otherwise('{"sitemap":[{"path":"s.xml","lastDownloaded":"2024-01-20T00:00:00Z"}]}')), item("data_report", k % 7 != 0, F.lit('{"reason":"SERVICE_DISABLED"}')),
        item("pages", yes, F.lit('{"impressions":5}')), item("queries", yes, F.when(k % 4 == 0, '{"rows":0}').otherwise('{"rows":3}')),
    )
    items = s.select("property", F.explode(F.array(*rows)).alias("x")).select("property", "x.*")
    return console.evaluate(items, F.lit("2024-02-01").cast("date"))


QUERIES = {f.__name__: f for f in (report_site_features, report_finding_kinds, report_caveats, link_architecture, robots_findings, exposed_files, speed_findings, console_findings)}

_ND = r"regexp_replace(regexp_replace(regexp_extract(lower(regexp_replace(domain, '^[\s ]+|[\s ]+$', '', 'g')), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:@]*)', 1), '^\.+|\.+$', '', 'g'), '^www\.', '')"
_LAST = f"""r AS (SELECT feed, {_ND} AS site, file_no, report_id, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS v FROM audit_reports),
l AS (SELECT feed, site, last(v ORDER BY file_no, report_id) AS v FROM r WHERE json_type(v) = 'OBJECT' AND site <> '' GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN json_type(v->'$.robots_found') = 'BOOLEAN' THEN CAST(v->>'$.robots_found' AS BOOLEAN) END AS robots, CASE WHEN json_type(v->'$.sitemap_url_count') <> 'BOOLEAN' THEN TRY_CAST(v->>'$.sitemap_url_count' AS BIGINT) END AS n,
 CASE WHEN json_type(v->'$.page_count') <> 'BOOLEAN' THEN TRY_CAST(v->>'$.page_count' AS BIGINT) END + coalesce(CASE WHEN json_type(v->'$.sweep_count') <> 'BOOLEAN' THEN TRY_CAST(v->>'$.sweep_count' AS BIGINT) END, 0) AS audited,
 CASE WHEN json_type(v->'$.sitemap_found') = 'BOOLEAN' THEN CAST(v->>'$.sitemap_found' AS BOOLEAN) END AS told, lower(list_filter(CAST(v->'$.health' AS JSON[]), lambda h: h->>'$[0]' = 'HSTS')[1]->>'$[1]') AS hsts FROM l),
g AS (SELECT *, coalesce(told, n > 0) AS sm, CASE WHEN hsts IS NOT NULL AND NOT regexp_matches(hsts, 'not checked|not tested|could not') THEN NOT regexp_matches(hsts, '✗|none|not found|not present') END AS h FROM f)"""
_YES = lambda c: f"CASE WHEN {c} THEN 'yes' WHEN NOT {c} THEN 'no' ELSE 'n/a' END"
#: Features whose parts the project's reports don't hold.
_BLANK = (
    "jsonld_home", "schema_home", "org_home", "breadcrumb", "faq", "analytics", "llms", "contact", "about", "privacy", "terms", "postal", "legal", "tls_days", "home_words", "home_title", "home_title_len", "home_desc_len", "home_h1", "client_rendered", "og_image",
    "social", "sameas", "google", "kw_primary", "kw_top5",
)
_SPEED_TITLES = {"SLOW": ("HIGH", "LCP fails Core Web Vitals (real users)"), "AVERAGE": ("MEDIUM", "LCP needs improvement (real users)")}
SQL = {
    "report_site_features": f"""WITH {_LAST} SELECT feed, site, 'robots_txt' AS feature, {_YES('robots')} AS value, robots AS present FROM g UNION ALL SELECT feed, site, 'sitemap', {_YES('sm')}, sm FROM g UNION ALL SELECT feed, site, 'sitemap_urls', coalesce(format('{{:,}}', n), 'n/a'), NULL FROM g
UNION ALL SELECT feed, site, 'hsts', {_YES('h')}, h FROM g UNION ALL SELECT feed, site, 'ai_edge', 'not tested', NULL FROM g UNION ALL SELECT feed, site, unnest([{','.join(f"'{b}'" for b in _BLANK)}]), 'n/a', NULL FROM g""",
    "report_finding_kinds": f"""WITH {_LAST}, x AS (SELECT feed, site, unnest(CAST(v->'$.site_findings' AS JSON[])) AS x FROM l WHERE json_type(v->'$.site_findings') = 'ARRAY'),
k AS (SELECT feed, site, coalesce(x->>'$.category', '') AS category, regexp_replace(x->>'$.title', '[0-9]+(?:\\.[0-9]+)?', '#', 'g') AS key, upper(coalesce(nullif(x->>'$.severity', ''), 'INFO')) AS severity FROM x WHERE json_type(x) = 'OBJECT' AND x->>'$.title' <> '')
SELECT feed, site, category, key, 'site-wide' AS part, count(*) AS n, first(severity ORDER BY coalesce(list_position(['CRITICAL','HIGH','MEDIUM','LOW','INFO'], severity), 9), severity) AS severity FROM k GROUP BY 1, 2, 3, 4""",
    "report_caveats": f"""WITH {_LAST}, m AS (SELECT feed, min(site) AS site FROM g GROUP BY 1), c AS (SELECT g.feed, g.audited AS a, g.sm AS cs FROM g JOIN m USING (feed, site)), j AS (SELECT g.feed, g.site, a, audited AS b, cs, sm AS s FROM g JOIN c USING (feed) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.feed = g.feed AND m.site = g.site)),
o AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN least(a, b) > 0 THEN greatest(a, b) / least(a, b) > 3 ELSE greatest(a, b) > 0 END ELSE false END AS o, CASE WHEN a > 0 AND b > 0 THEN round(greatest(a, b) / least(a, b), 1) END AS ratio FROM j)
SELECT feed, site, ratio, o AS over_limit, CASE WHEN o OR coalesce(NOT s, false) OR coalesce(NOT cs, false) THEN true WHEN a IS NULL OR b IS NULL OR s IS NULL OR cs IS NULL THEN NULL ELSE false END AS caveat FROM o""",
    "link_architecture": f"""WITH t AS (SELECT o_custkey AS site, o_orderkey AS k, {_pick_sql('o_orderkey', (200, 200, 404, 301, 500, 200, 410, 200))} AS st FROM orders),
f AS (SELECT *, st IN (404, 410) AS gone, st >= 500 AS down, st NOT IN (404, 410) AND st < 500 AS up, k % 10 IN (0, 1) AS slash, k % 10 = 2 AS away, st = 200 AND k % 13 = 0 AS hidden, st = 200 AND k % 13 <> 0 AND k % 9 = 0 AS other FROM t)
SELECT site, CAST(count(*) AS INTEGER) AS linked_sample, CAST(count(*) FILTER (gone) AS INTEGER) AS links_broken, CAST(count(*) FILTER (down) AS INTEGER) AS links_5xx, CAST(count(*) FILTER (up AND away) AS INTEGER) AS links_redirect, CAST(count(*) FILTER (up AND slash) AS INTEGER) AS links_trivial,
CAST(count(*) FILTER (other) AS INTEGER) AS links_noncanonical, CAST(count(*) FILTER (hidden) AS INTEGER) AS links_noindex, true AS canonical_unlinked FROM f GROUP BY 1""",
    "robots_findings": """WITH n AS (SELECT n_name AS site, n_nationkey % 6 AS t, n_nationkey % 7 = 6 AS down FROM nation)
SELECT site, 'CRITICAL' AS severity, 'robots.txt returns a server error' AS title FROM n WHERE down UNION ALL SELECT site, 'CRITICAL', 'robots.txt blocks all crawlers' FROM n WHERE NOT down AND t = 0 UNION ALL SELECT site, 'LOW', 'Sitemap not referenced in robots.txt' FROM n WHERE NOT down AND t IN (0, 2, 3)
UNION ALL SELECT site, 'MEDIUM', 'robots.txt blocks AI search crawlers' FROM n WHERE NOT down AND t = 1 UNION ALL SELECT site, 'LOW', 'robots.txt blocks AI training crawlers' FROM n WHERE NOT down AND t = 2 UNION ALL SELECT site, 'HIGH', 'robots.txt is an HTML page' FROM n WHERE NOT down AND t = 3
UNION ALL SELECT site, 'MEDIUM', 'robots.txt not found' FROM n WHERE NOT down AND t = 4""",
    "exposed_files": "SELECT s_suppkey AS site, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE CASE WHEN s_suppkey % 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END END AS exposed_files FROM supplier",
    "speed_findings": f"""WITH c AS (SELECT c_custkey AS site, {_pick_sql('c_custkey', SPEEDS)} AS s, {_pick_sql('c_custkey', LEVELS)} AS l FROM customer)
SELECT site, 'HIGH' AS severity, 'Poor PageSpeed performance score' AS title FROM c WHERE s < 50 UNION ALL SELECT site, 'MEDIUM', 'PageSpeed performance below 90' FROM c WHERE s BETWEEN 50 AND 89 UNION ALL SELECT site, 'MEDIUM', 'Text too small to read on mobile' FROM c WHERE site % 2 = 0
""" + "".join(f" UNION ALL SELECT site, '{s}', '{t}' FROM c WHERE l = '{level}'" for level, (s, t) in _SPEED_TITLES.items()),
    "console_findings": """WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS property, s_suppkey AS k FROM supplier)
SELECT property, 'HIGH' AS severity, 'analytics' AS area, 'GA4 event data retention is TWO_MONTHS' AS title FROM s WHERE k % 2 = 0 UNION ALL SELECT property, 'HIGH', 'analytics', 'No GA4 key event for leads' FROM s WHERE k % 3 = 0 UNION ALL SELECT property, 'HIGH', 'search-console', 'No sitemap submitted to Search Console' FROM s WHERE k % 5 = 0
UNION ALL SELECT property, 'INFO', 'analytics', 'GA4 Data API is not enabled for the service account''s project' FROM s WHERE k % 7 = 0 UNION ALL SELECT property, 'INFO', 'search-console', 'No queries visible (anonymized by Search Console)' FROM s WHERE k % 4 = 0""",
}
