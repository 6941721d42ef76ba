"""Audit plans over the table of captured pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.functions import text, urls
from sitelode.operators import rules, sampling, scoring
from sitelode.session import table


#: Sources of pages that were taken from a sitemap.
LISTED = ("sitemap", "sweep")


def facts(pages: DataFrame) -> DataFrame:
    """The facts that the table of pages holds, one row for each page."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    p = pages.select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"), "canonical", "source", "status", urls.normalize_domain("domain").alias("site"), urls.scheme("url").alias("scheme"), blank("title").alias("title"), blank("description").alias("description"),
        F.col("word_count").alias("words"), F.coalesce(F.size(F.filter("h1", lambda h: F.trim(h) != "")), F.lit(0)).alias("h1_count"), urls.strip_www(urls.host("canonical")).alias("canonical_host"),
        urls.scheme("canonical").alias("canonical_scheme"), F.when(F.col("canonical").isNotNull(), urls.path("canonical")).alias("canonical_path"), urls.path("url").alias("final_path"), urls.path("url").alias("slug_path"),
        urls.strip_www(urls.host("url")).alias("final_host"), blank("lang").alias("lang"), F.col("robots").alias("meta_robots"), "internal_links", "client_rendered", "schema_types", urls.url_template("url").alias("template"), urls.path_depth("url").alias("depth"),
    )
    return p


def _shared(p: DataFrame, col: str, name: str) -> DataFrame:
    """Pages with the number of pages of their site that share the column; combined before the shuffle and joined, so no window over a site."""
    sharers = p.where(F.col(col) != "").groupBy("site", col).agg(F.count("*").alias(name)).where(F.col(name) > 1)
    return p.join(sharers, ["site", col], "left")


def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared(_shared(facts(table(spark, sf_dir, "pages")), "title", "title_sharers"), "description", "description_sharers")


def _page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.findings(page_facts(spark, sf_dir), rules.P, ["page_id", "site", "url", "template", "source"])


def page_rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that a page breaks."""
    return _page_findings(spark, sf_dir).select("page_id", "severity", "category", "title")


def _ordered(found: DataFrame) -> DataFrame:
    return found.withColumn("ord", F.struct("page_id", "rule"))


def category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.category_scores(_ordered(_page_findings(spark, sf_dir)))


def overall_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.overall_scores(category_scores(spark, sf_dir))


def top_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.top_priorities(_ordered(_page_findings(spark, sf_dir)))


def sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of swept pages that no other page of the site has, rolled up."""
    found = _ordered(_page_findings(spark, sf_dir))
    swept = facts(table(spark, sf_dir, "pages")).where("source = 'sweep'").groupBy("site").agg(F.count("*").alias("n_pages"))
    return scoring.sweep_summary(found.where("source = 'sweep'"), swept, found.where("source <> 'sweep'"))


def duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = facts(table(spark, sf_dir, "pages")).where("title <> ''")
    return p.groupBy("site", "title").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page")).where("n_pages > 1")


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").where("url is not null").select(
        "page_id", urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.path(u).alias("path"), urls.query(u).alias("query"), urls.url_template(u).alias("template"), urls.path_depth(u).alias("depth"), urls.norm_url(u).alias("norm"),
        urls.registrable(urls.host(u)).alias("registrable"), urls.site_name(urls.strip_www(urls.host(u))).alias("name"), urls.url_key(u).alias("url_key"), urls.same_site(u, F.col("canonical")).alias("canonical_same_site"),
    )


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of each template of a site, how many were audited, and gaps."""
    p = facts(table(spark, sf_dir, "pages"))
    by = p.groupBy("site", "template").agg(F.count_distinct("url").alias("n_urls"), F.count_distinct(F.when(F.col("source") != "sweep", F.col("url"))).alias("n_audited"))
    return by.withColumn("gap", (F.col("n_urls") >= 5) & (F.col("n_audited") == 0))


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen pages of each site, spread over its templates (a sampling operator)."""
    p = facts(table(spark, sf_dir, "pages")).select("site", "template", "page_id")
    return sampling.stratified(p, ["site"], "template", ["page_id"], 15)


def sitemap_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site's pages that come from its sitemap by what is wrong with listing them (redirects, errors, noindex, other canonical), and all pages that refuse."""
    p = facts(table(spark, sf_dir, "pages"))
    listed = F.col("source").isin(*LISTED)
    noindex = F.lower("meta_robots").contains("noindex")
    other = urls.same_site("canonical", "url") & (F.rtrim("canonical", F.lit("/")) != F.rtrim("url", F.lit("/")))
    return p.groupBy("site").agg(
        F.count_if(listed).alias("sm_checked"), F.count_if(listed & F.col("status").between(300, 399)).alias("sm_redirects"), F.count_if(listed & (F.col("status").isin(404, 410) | (F.col("status") >= 500))).alias("sm_dead"),
        F.count_if(listed & noindex).alias("sm_noindex"), F.count_if(listed & other).alias("sm_noncanonical"), F.count_if(F.col("status").isin(401, 403, 406, 429)).alias("refused_pages"),
    )


def site_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pages of a site tell about the site."""
    p = facts(table(spark, sf_dir, "pages"))
    legal = F.lower("url").rlike("privacy|terms|legal|imprint|impressum|cookie")
    described = (F.col("description") != "") & ~legal
    typed = lambda *t: F.arrays_overlap(F.coalesce("schema_types", F.array().cast("array<string>")), F.array(*map(F.lit, t)))
    own = p.groupBy("site").agg(
        F.count("*").cast("int").alias("pages"), F.count_if(F.col("source") != "sweep").cast("int").alias("deep_pages"), F.bool_or(F.col("words") > 0).alias("any_text"), F.max("depth").alias("max_depth"),
        F.coalesce(F.bool_or(typed("BreadcrumbList")), F.lit(False)).alias("any_breadcrumb"), F.count_if(described).cast("int").alias("descriptions"), F.count_if(described & ~text.has_cta("description")).cast("int").alias("descriptions_no_cta"),
        F.bool_or(F.when(F.col("source") == "homepage", F.coalesce(typed("Organization", "WebSite", "LocalBusiness"), F.lit(False)))).alias("org_schema"),
        F.max(F.when(F.col("source") == "homepage", F.col("status"))).alias("home_status"),
    )
    hygiene = sitemap_hygiene(spark, sf_dir)
    return own.join(hygiene.select("site", *(F.col(c).cast("int").alias(c) for c in hygiene.columns if c != "site")), "site")


def site_rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that a site breaks, as far as its pages tell."""
    return rules.findings(site_facts(spark, sf_dir), rules.S, ["site"]).select("site", "severity", "category", "title")


QUERIES = {f.__name__: f for f in (page_rule_findings, category_scores, overall_scores, top_priorities, sweep_summary, duplicate_titles, url_parts, coverage, stratified_sample, sitemap_hygiene, site_rule_findings)}

_ND = r"regexp_replace(regexp_replace(regexp_extract(lower(regexp_replace(domain, '^[\s ]+|[\s ]+$', '', 'g')), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:@]*)', 1), '^\.+|\.+$', '', 'g'), '^www\.', '')"
_HOST = r"coalesce(lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '')"
_SCHEME = r"coalesce(lower(regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)), '')"
_PATH = r"coalesce(regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), '')"
_BASE = rf"""
s AS (SELECT page_id, coalesce(url, '') AS url, source, status, coalesce({_ND}, '') AS site, trim(coalesce(title, '')) AS title, trim(coalesce(description, '')) AS description, word_count AS words,
 coalesce(len(list_filter(h1, lambda h: trim(h) <> '')), 0) AS h1, canonical, trim(coalesce(lang, '')) AS lang, robots, internal_links, coalesce(client_rendered, false) AS rendered, schema_types FROM pages),
u AS (SELECT *, {_SCHEME.format('url')} AS scheme, regexp_replace({_HOST.format('url')}, '^www\.', '') AS host, {_PATH.format('url')} AS path, {_SCHEME.format('canonical')} AS cscheme, regexp_replace({_HOST.format('canonical')}, '^www\.', '') AS chost,
 CASE WHEN canonical IS NOT NULL THEN {_PATH.format('canonical')} END AS cpath FROM s),
g AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs FROM u),
p AS (SELECT *, len(segs) AS depth, CASE WHEN len(segs) = 0 THEN '/' WHEN len(segs) = 1 THEN '/*' || CASE WHEN ends_with(path, '/') THEN '/' ELSE '' END
 ELSE '/' || CASE WHEN regexp_matches(segs[1], '^(19|20)\d{{2}}$') THEN '{{year}}' ELSE segs[1] END || repeat('/*', len(segs) - 1) || CASE WHEN ends_with(path, '/') THEN '/' ELSE '' END END AS template,
 CASE WHEN title <> '' THEN count(*) OVER (PARTITION BY site, title) END AS tn, CASE WHEN description <> '' THEN count(*) OVER (PARTITION BY site, description) END AS dn FROM g)"""

#: The same rules over this table's columns, said once more for the SQL check: (severity, category, title, condition).
_CHECKED = (
    ("'CRITICAL'", "crawlability", "'Server error ' || status", "status >= 500"),
    ("'HIGH'", "crawlability", "'Client error ' || status", "status BETWEEN 400 AND 499"),
    ("'CRITICAL'", "crawlability", "'Page may be client-rendered — content missing from raw HTML'", "rendered"),
    ("'HIGH'", "ai search", "'Content invisible to AI crawlers'", "rendered"),
    ("'HIGH'", "crawlability", "'Possible soft 404 (200 OK with empty body)'", "words = 0 AND status = 200 AND title = ''"),
    ("'HIGH'", "crawlability", "'Page set to noindex'", "lower(robots) LIKE '%noindex%' OR lower(trim(robots)) = 'none'"),
    ("'HIGH'", "on page", "'Missing title tag'", "title = ''"),
    ("'LOW'", "on page", "'Title too long'", "length(title) > 65"),
    ("'LOW'", "on page", "'Title very short'", "length(title) BETWEEN 1 AND 24"),
    ("'MEDIUM'", "on page", "'Missing meta description'", "description = ''"),
    ("'LOW'", "on page", "'Meta description too long'", "length(description) > 170"),
    ("'LOW'", "on page", "'Meta description short'", "length(description) BETWEEN 1 AND 69"),
    ("'HIGH'", "on page", "'Missing H1 tag'", "h1 = 0 AND NOT rendered"),
    ("'LOW'", "on page", "'Multiple H1 tags'", "h1 > 1"),
    ("'MEDIUM'", "on page", "'Thin content (<300 words)'", "words < 300 AND status = 200 AND NOT rendered"),
    ("'LOW'", "on page", "'Missing canonical tag'", "cpath IS NULL AND chost = '' AND status = 200 AND words > 0"),
    ("'MEDIUM'", "crawlability", "'Canonical points to another domain'", "cscheme IN ('http', 'https') AND chost <> host"),
    ("'MEDIUM'", "crawlability", "'Canonical points at the http:// version'", "chost = host AND cscheme = 'http' AND scheme = 'https'"),
    ("'MEDIUM'", "crawlability", "'Canonicalized to a different URL'", "chost = host AND NOT (cscheme = 'http' AND scheme = 'https') AND rtrim(cpath, '/') <> rtrim(path, '/')"),
    ("'LOW'", "on page", "'URL slug not clean'", "regexp_matches(path, '[A-Z]|_|%20')"),
    ("'LOW'", "on page", "'Dead-end page (no internal links)'", "status = 200 AND words > 100 AND internal_links = 0"),
    ("'LOW'", "on page", "'Very high internal link count'", "status = 200 AND words > 100 AND internal_links > 300"),
    ("'CRITICAL'", "trust", "'Not served over HTTPS'", "scheme <> 'https'"),
    ("'LOW'", "ai search", "'Missing html lang attribute'", "lang = ''"),
    ("'MEDIUM'", "on page", "'Duplicate meta description across pages'", "dn > 1"),
    ("'MEDIUM'", "on page", "'Duplicate title across pages'", "tn > 1"),
)
_FOUND = _BASE + ", f AS (SELECT page_id, site, url, template, source, 0 AS r, 'CRITICAL' AS severity, 'crawlability' AS category, 'Page unreachable' AS title, 3 AS effort, 5 AS impact FROM p WHERE status = 0" + "".join(
    f" UNION ALL SELECT page_id, site, url, template, source, {i + 1}, {sev}, '{cat}', {title}, 0, 0 FROM p WHERE status IS DISTINCT FROM 0 AND ({cond})" for i, (sev, cat, title, cond) in enumerate(_CHECKED)
) + ")"
_CATALOGUE = {r[5]: (r[3], r[4]) for r in rules.RULES if r[0] == rules.P and not r[5].startswith("=")}
_EFFORT = "CASE " + " ".join(f"WHEN title = '{t.replace(chr(39), chr(39) * 2)}' THEN {e}" for t, (_, e) in _CATALOGUE.items()) + " WHEN title LIKE 'Server error%' THEN 3 ELSE 2 END"
_IMPACT = "CASE " + " ".join(f"WHEN title = '{t.replace(chr(39), chr(39) * 2)}' THEN {i}" for t, (i, _) in _CATALOGUE.items()) + " WHEN title LIKE 'Server error%' THEN 5 ELSE 4 END"
_ONE = _FOUND + ", d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, category, title ORDER BY page_id, r) AS a FROM f) WHERE a = 1)"
_SCORES = _ONE + """, w AS (SELECT *, CASE severity WHEN 'CRITICAL' THEN 40 WHEN 'HIGH' THEN 20 WHEN 'MEDIUM' THEN 10 WHEN 'LOW' THEN 4 ELSE 0 END AS w FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY site, category ORDER BY w DESC, title) AS rn FROM w),
c AS (SELECT site, category, CAST(greatest(0, round_even(100 - sum(w * CASE WHEN rn <= 2 THEN 1.0 WHEN rn <= 4 THEN 0.75 ELSE 0.5 END), 0)) AS INTEGER) AS score, count(*) AS n_findings FROM k GROUP BY 1, 2)"""
_WEIGHT = "CASE category " + " ".join(f"WHEN '{c}' THEN {w}" for c, w in scoring.CATEGORY_WEIGHTS.items()) + " END"
_PART = {"scheme": _SCHEME.format("url"), "host": _HOST.format("url"), "path": _PATH.format("url")}
SQL = {
    "page_rule_findings": f"WITH {_FOUND} SELECT page_id, severity, category, title FROM f",
    "category_scores": f"WITH {_SCORES} SELECT * FROM c",
    "overall_scores": f"WITH {_SCORES} SELECT site, CAST(round_even(100 - CAST(sum((100 - score) * CAST({_WEIGHT} AS DECIMAL(4,2))) AS DOUBLE), 0) AS INTEGER) AS overall FROM c GROUP BY site",
    "top_priorities": f"""WITH {_ONE}, x AS (SELECT *, list_position(['CRITICAL','HIGH','MEDIUM','LOW','INFO'], severity) AS sr, {_EFFORT} AS e, {_IMPACT} AS im FROM d WHERE severity <> 'INFO'),
t AS (SELECT *, row_number() OVER (PARTITION BY site, title ORDER BY sr, e, -im, page_id, r) AS b FROM x), y AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY sr, e, -im, page_id, r, title) AS place FROM t WHERE b = 1)
SELECT site, CAST(place AS INTEGER) AS place, title, category, severity FROM y WHERE place <= 8""",
    "sweep_summary": f"""WITH {_FOUND}, deep AS (SELECT DISTINCT site, category, title FROM f WHERE source <> 'sweep'), n AS (SELECT site, count(*) AS n_pages FROM p WHERE source = 'sweep' GROUP BY 1),
o AS (SELECT f.site, f.category, f.title, count(*) AS n, count(DISTINCT template) AS n_templates, first(url ORDER BY page_id, r) AS example, first(severity ORDER BY page_id, r) AS first_severity FROM f ANTI JOIN deep USING (site, category, title) WHERE source = 'sweep' AND severity <> 'INFO' GROUP BY 1, 2, 3)
SELECT o.*, CASE WHEN n < greatest(2, n_pages * 0.1) AND first_severity = 'HIGH' THEN 'MEDIUM' WHEN n < greatest(2, n_pages * 0.1) AND first_severity = 'MEDIUM' THEN 'LOW' ELSE first_severity END AS severity FROM o JOIN n USING (site)""",
    "duplicate_titles": f"WITH {_BASE} SELECT site, title, count(*) AS n_pages, min(page_id) AS first_page FROM p WHERE title <> '' GROUP BY 1, 2 HAVING count(*) > 1",
    "coverage": f"WITH {_BASE}, c AS (SELECT site, template, count(DISTINCT url) AS n_urls, count(DISTINCT CASE WHEN source <> 'sweep' THEN url END) AS n_audited FROM p GROUP BY 1, 2) SELECT *, n_urls >= 5 AND n_audited = 0 AS gap FROM c",
    "stratified_sample": f"""WITH {_BASE}, i AS (SELECT site, template, page_id, row_number() OVER (PARTITION BY site, template ORDER BY page_id) - 1 AS i, count(*) OVER (PARTITION BY site, template) AS n, min(page_id) OVER (PARTITION BY site, template) AS f FROM p),
st AS (SELECT DISTINCT site, template, n, f FROM i), rk AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, f) AS rk FROM st), sl AS (SELECT *, unnest(range(0, n)) AS j FROM rk),
tu AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY j, rk) AS t FROM sl), q AS (SELECT site, template, count(*) AS k FROM tu WHERE t <= 15 GROUP BY 1, 2),
x AS (SELECT i.*, k FROM i JOIN q USING (site, template))
SELECT site, template, page_id FROM x WHERE k >= n OR len(list_filter(range(0, k), lambda z: floor(z * (CAST(n AS DOUBLE) / k)) = i)) > 0""",
    "sitemap_hygiene": f"""WITH {_BASE} SELECT site, count(*) FILTER (l) AS sm_checked, count(*) FILTER (l AND status BETWEEN 300 AND 399) AS sm_redirects, count(*) FILTER (l AND (status IN (404, 410) OR status >= 500)) AS sm_dead, count(*) FILTER (l AND lower(robots) LIKE '%noindex%') AS sm_noindex,
count(*) FILTER (l AND canonical IS NOT NULL AND chost = host AND rtrim(canonical, '/') <> rtrim(url, '/')) AS sm_noncanonical, count(*) FILTER (status IN (401, 403, 406, 429)) AS refused_pages FROM (SELECT *, source IN ('sitemap', 'sweep') AS l FROM p) GROUP BY 1""",
    "url_parts": f"""WITH u AS (SELECT page_id, url, canonical, {', '.join(f'{e} AS {n}' for n, e in _PART.items())}, coalesce(regexp_extract(url, '\\?([^#]*)', 1), '') AS query FROM pages WHERE url IS NOT NULL), b AS (SELECT page_id, template, depth FROM (WITH {_BASE} SELECT page_id, template, depth FROM p)),
h AS (SELECT *, regexp_replace(host, '^www\\.', '') AS bare FROM u), l AS (SELECT *, string_split(bare, '.') AS ls FROM h)
SELECT page_id, scheme, host, path, query, template, CAST(depth AS INTEGER) AS depth, lower(bare || rtrim(path, '/')) AS norm,
CASE WHEN len(ls) >= 3 AND len(ls[-1]) = 2 AND ls[-2] IN ({','.join(f"'{x}'" for x in urls.REGISTRABLE_SECOND_LEVEL)}) THEN array_to_string(ls[-3:], '.') ELSE array_to_string(ls[-2:], '.') END AS registrable,
CASE WHEN len(ls) >= 3 AND len(ls[-1]) = 2 AND ls[-2] IN ({','.join(f"'{x}'" for x in urls.SITE_SECOND_LEVEL)}) THEN ls[-3] WHEN len(ls) >= 2 THEN ls[-2] ELSE ls[1] END AS name,
regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') AS url_key, bare = regexp_replace({_HOST.format('canonical')}, '^www\\.', '') AS canonical_same_site FROM l JOIN b USING (page_id)""",
    "site_rule_findings": f"""WITH {_BASE}, v AS (SELECT *, lower(description) AS ld, source IN ('sitemap', 'sweep') AS l, coalesce(schema_types, []) AS st FROM p),
k AS (SELECT *, description <> '' AND NOT regexp_matches(lower(url), 'privacy|terms|legal|imprint|impressum|cookie') AS told, len(list_filter([{", ".join(f"'{verb}'" for verb in text.CTA_VERBS)}], lambda x: contains(' ' || ld || ' ', ' ' || x || ' ') OR starts_with(ld, x || ' '))) > 0 AS cta FROM v),
sf AS (SELECT site, count(*) FILTER (source <> 'sweep') AS deep, bool_or(words > 0) AS txt, max(depth) AS md, coalesce(bool_or(list_contains(st, 'BreadcrumbList')), false) AS bc, count(*) FILTER (told) AS d, count(*) FILTER (told AND NOT cta) AS dn,
bool_or(list_has_any(list_filter(st, lambda x: x IS NOT NULL), ['Organization', 'WebSite', 'LocalBusiness'])) FILTER (source = 'homepage') AS org, max(status) FILTER (source = 'homepage') AS home, count(*) FILTER (l) AS c, count(*) FILTER (l AND status BETWEEN 300 AND 399) AS r,
count(*) FILTER (l AND (status IN (404, 410) OR status >= 500)) AS dd, count(*) FILTER (l AND lower(robots) LIKE '%noindex%') AS ni, count(*) FILTER (l AND canonical IS NOT NULL AND chost = host AND rtrim(canonical, '/') <> rtrim(url, '/')) AS nc, count(*) FILTER (status IN (401, 403, 406, 429)) AS rf FROM k GROUP BY 1)
SELECT site, 'LOW' AS severity, 'schema' AS category, 'No BreadcrumbList schema on any crawled page' AS title FROM sf WHERE deep >= 3 AND txt AND md >= 2 AND NOT bc
UNION ALL SELECT site, 'LOW', 'on page', 'Most meta descriptions lack a call to action' FROM sf WHERE d >= 3 AND dn * 2 > d UNION ALL SELECT site, 'CRITICAL', 'crawlability', 'The homepage does not load' FROM sf WHERE home >= 400
UNION ALL SELECT site, 'LOW', 'crawlability', 'Sitemap lists redirecting URLs (' || r || ')' FROM sf WHERE r >= 2 UNION ALL SELECT site, CASE WHEN dd >= greatest(2, 0.1 * c) THEN 'HIGH' ELSE 'MEDIUM' END, 'crawlability', 'Sitemap lists URLs that return errors (' || dd || ' of ' || c || ' checked)' FROM sf WHERE dd > 0
UNION ALL SELECT site, 'MEDIUM', 'crawlability', 'Sitemap lists noindexed URLs (' || ni || ' of ' || c || ' checked)' FROM sf WHERE ni > 0 UNION ALL SELECT site, 'MEDIUM', 'crawlability', 'Sitemap lists non-canonical URLs (' || nc || ' of ' || c || ' checked)' FROM sf WHERE nc >= 2
UNION ALL SELECT site, 'INFO', 'crawlability', 'Site refuses non-browser user-agents' FROM sf WHERE rf > 0 UNION ALL SELECT site, 'LOW', 'schema', 'No Organization/WebSite schema on homepage' FROM sf WHERE NOT org""",
}
