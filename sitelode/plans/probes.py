"""Plans over captured probes. The project's tables hold none, so each relation is derived from one by arithmetic on its keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.functions import urls
from sitelode.operators import captures, compare, rules, site_checks
from sitelode.session import table


def _pick(key: Column, values: tuple) -> Column:
    """One of the values in turn, by the key."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def _pick_sql(key: str, values: tuple) -> str:
    return "([" + ",".join(f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v) for v in values) + f"])[({key}) % {len(values)} + 1]"


STATUSES = (200, 200, 403, 402, 503, 0, 200)
ROLES = ("search", "user", "train")
LINK_STATUSES = (200, 200, 404, 301, 500, 200, 410, 200)
DAYS = (-3, 0, 14, 15, 30, 31, 90)


def agent_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each agent gets at the edge, over two URLs."""
    e = table(spark, sf_dir, "events")
    k = F.expr("event_id div 2")
    probes = e.select(F.pmod(k, F.lit(40)).alias("site"), F.concat(F.lit("agent-"), F.floor(k / 40)).alias("agent"), _pick(k, ROLES).alias("role"), F.pmod("event_id", F.lit(2)).cast("int").alias("url_no"), _pick(F.col("event_id"), STATUSES).alias("status"), (F.pmod("event_id", F.lit(11)) == 0).alias("mitigated"))
    return captures.agent_verdicts(probes)


def agent_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings that follow from the agents' verdicts."""
    return rules.findings(captures.agent_facts(agent_matrix(spark, sf_dir)).withColumn("home_status", F.lit(200)), rules.S, ["site"]).select("site", "severity", "title")


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("site"), F.col("o_orderkey").alias("k"))
    base = F.concat(F.lit("https://s.test/p/"), "k")
    final = F.when(F.col("k") % 10 == 1, F.concat(base, F.lit("/"))).when(F.col("k") % 10 == 2, F.concat(F.lit("https://s.test/q/"), "k")).otherwise(base)
    canonical = F.when(F.col("k") % 9 == 0, F.lit("https://s.test/other")).when(F.col("k") % 9 == 1, final).otherwise("")
    return o.select("site", base.alias("url"), final.alias("final_url"), _pick(F.col("k"), LINK_STATUSES).alias("status"), F.when(F.col("k") % 10 < 3, 1).otherwise(0).alias("hops"), canonical.alias("canonical"), (F.col("k") % 13 == 0).alias("noindex"))


def link_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled link targets by what is wrong with them."""
    return captures.classify_links(_targets(spark, sf_dir))


def orphan_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates whose sitemap URLs no page links to."""
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("site"), F.concat(F.lit("https://s.test/t"), F.pmod("p_partkey", F.lit(3)), F.lit("/"), F.col("p_partkey")).alias("url"), "p_partkey")
    return captures.orphan_templates(p.select("site", "url"), p.where("p_partkey % 3 = 1").select("site", "url"), 5)


def head_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites where HEAD fails and GET doesn't; odd line items are GET, even ones HEAD."""
    l = table(spark, sf_dir, "lineitem")
    c = l.select(F.pmod("l_orderkey", F.lit(200)).alias("site"), F.col("l_orderkey").alias("url"), F.when(F.col("l_linenumber") % 2 == 1, "GET").otherwise("HEAD").alias("method"), _pick(F.col("l_partkey"), (200, 200, 405, 404)).alias("status"))
    return site_checks.head_failures(c)


def certificate_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on certificates by the days they are still valid, rounded down."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site"), _pick(F.col("c_custkey"), DAYS).alias("d"))
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    until = F.timestamp_seconds(F.unix_timestamp(now) + F.col("d") * 86400 + F.pmod("site", F.lit(2)) * 3600)
    return rules.findings(c.select("site", captures.days_left(until, now).alias("cert_days")), rules.S, ["site"]).select("site", "severity", "title")


def rating_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that declare several review counts on one site."""
    p = table(spark, sf_dir, "part")
    return captures.rating_conflicts(p.select(F.col("p_type").alias("site"), F.col("p_brand").alias("name"), F.col("p_size").alias("reviews")))


def mail_auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sending domain lacks; unknown answers tell nothing."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site"))
    spf = F.when(F.col("site") % 4 == 0, F.lit(None).cast("array<string>")).when(F.col("site") % 4 == 1, F.array(F.lit("v=spf1 -all"))).otherwise(F.array().cast("array<string>"))
    dmarc = F.when(F.col("site") % 3 == 0, F.array(F.lit("v=DMARC1; p=none"))).when(F.col("site") % 3 == 1, F.array(F.lit("v=DMARC1; rua=mailto:x"))).otherwise(F.array().cast("array<string>"))
    rows = s.select("site", F.lit("spf").alias("kind"), spf.alias("answers")).union(s.select("site", F.lit("dmarc").alias("kind"), dmarc.alias("answers")))
    return captures.mail_facts(rows).select("site", "dmarc", "dmarc_reports", "missing_mail_auth")


def host_variant_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the variants of a site's address end."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("site"), F.col("o_orderkey").alias("k"))
    final = _pick(F.col("k"), ("http://x.test/", "https://x.test/", "https://www.x.test/"))
    return captures.host_variants(o.select("site", F.lit("https://x.test/").alias("canonical"), final.alias("final_url"), _pick(F.floor(F.col("k") / 3), (200, 200, 0, 404)).alias("status")))


def feature_advantages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that other suppliers have and supplier 1 lacks; some are unknown."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("site"), F.col("s_suppkey").alias("k"))
    f = s.select("site", "k", F.explode(F.array(*map(F.lit, range(6)))).alias("i"))
    present = F.when((F.col("k") + F.col("i")) % 5 == 0, F.lit(None).cast("boolean")).otherwise((F.col("k") * 3 + F.col("i")) % 2 == 0)
    return compare.advantages(f.select("site", F.concat(F.lit("f"), "i").alias("feature"), present.alias("present")), "1")


def keyword_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of other sites that the first site shares or misses."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("site"), F.col("p_partkey").cast("int").alias("place"), F.col("p_type").alias("term"))
    return compare.keyword_overlap(p, "Brand#11")


def affiliate_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracking labels of derived links."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return o.select("k", urls.affiliate_kind(_pick(F.col("k"), LINKS)).alias("kind"))


LINKS = ("https://www.amazon.test/dp/1?tag=a", "https://go.awin1.com/x", "https://x.test/?a=1&irclickid=9", "https://x.test/?tag=1", "https://www.viator.com/t?pid=P12", "https://www.booking.com/h?aid=77", "https://affiliate.x.test/z", "http://www.getyourguide.com/?partner_id=q")
KINDS = ("Amazon tag=", "go.awin1.com", "affiliate click id", "", "Viator pid=", "Booking.com aid=", "affiliate.x.test", "GetYourGuide partner_id=")

QUERIES = {
    f.__name__: f
    for f in (agent_matrix, agent_findings, link_classes, orphan_templates, head_parity, certificate_findings, rating_conflicts, mail_auth, host_variant_facts, feature_advantages, keyword_overlap, affiliate_kinds)
}

_MATRIX = f"""e AS (SELECT event_id, event_id // 2 AS k, event_id % 2 AS url_no, {_pick_sql('event_id', STATUSES)} AS status, event_id % 11 = 0 AS mitigated FROM events),
v AS (SELECT k % 40 AS site, 'agent-' || (k // 40) AS agent, {_pick_sql('k', ROLES)} AS role, url_no, CASE WHEN status = 402 THEN 'pay per crawl' WHEN mitigated THEN 'challenged' WHEN status BETWEEN 200 AND 399 THEN 'ok' WHEN status IN (401, 403, 406, 429, 503) THEN 'refused' ELSE 'no answer' END AS v FROM e),
g AS (SELECT site, agent, role, count(*) AS n, count(*) FILTER (v = 'ok') AS ok, first(v ORDER BY url_no) FILTER (v <> 'ok') AS bad FROM v GROUP BY 1, 2, 3),
m AS (SELECT site, agent, role, CASE WHEN ok = n THEN 'ok' WHEN ok = 0 THEN bad ELSE bad || ' on some pages' END AS verdict FROM g)"""
_TITLES = {"expired": "TLS certificate expired", "soon": "TLS certificate expires very soon", "month": "TLS certificate expires within 30 days"}
SQL = {
    "agent_matrix": f"WITH {_MATRIX} SELECT * FROM m",
    "agent_findings": f"""WITH {_MATRIX}, f AS (SELECT site, count(*) FILTER (verdict = 'ok') AS ok, count(*) FILTER (verdict IN ('refused', 'challenged', 'pay per crawl') AND role <> 'train') AS ans, count(*) FILTER (verdict IN ('refused', 'challenged', 'pay per crawl') AND role = 'train') AS tr FROM m GROUP BY 1)
SELECT site, 'MEDIUM' AS severity, 'Site refuses every non-browser user-agent we tried' AS title FROM f WHERE ok = 0 UNION ALL SELECT site, 'HIGH', 'AI search / assistant crawlers are refused at the edge' FROM f WHERE ok > 0 AND ans > 0
UNION ALL SELECT site, 'MEDIUM', 'AI training crawlers are refused at the edge' FROM f WHERE ok > 0 AND ans = 0 AND tr > 0""",
    "link_classes": f"""WITH t AS (SELECT o_custkey AS site, o_orderkey AS k, {_pick_sql('o_orderkey', LINK_STATUSES)} AS status FROM orders)
SELECT site, CASE WHEN status IN (404, 410) THEN 'broken' WHEN status >= 500 THEN 'server error' WHEN k % 10 IN (0, 1) THEN 'trivial redirect' WHEN k % 10 = 2 THEN 'redirect' WHEN k % 13 = 0 THEN 'noindex' WHEN k % 9 = 0 THEN 'non-canonical' ELSE 'fine' END AS kind, count(*) AS n FROM t GROUP BY ALL""",
    "orphan_templates": "SELECT p_size AS site, '/t' || (p_partkey % 3) || '/*' AS template, count(*) AS n_urls FROM part WHERE p_partkey % 3 <> 1 GROUP BY ALL HAVING count(*) >= 5",
    "head_parity": f"""WITH c AS (SELECT l_orderkey % 200 AS site, l_orderkey AS url, l_linenumber AS m, {_pick_sql('l_partkey', (200, 200, 405, 404))} AS status FROM lineitem),
g AS (SELECT site, url, max(status) FILTER (m % 2 = 1) AS g, max(status) FILTER (m % 2 = 0) AS h FROM c GROUP BY 1, 2) SELECT site, CAST(count(*) FILTER (g = 200 AND h >= 400) AS INTEGER) AS head_failures FROM g GROUP BY 1""",
    "certificate_findings": f"""WITH c AS (SELECT c_custkey AS site, {_pick_sql('c_custkey', DAYS)} AS d FROM customer)
SELECT site, CASE WHEN d < 0 THEN 'CRITICAL' WHEN d <= 14 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CASE WHEN d < 0 THEN '{_TITLES["expired"]}' WHEN d <= 14 THEN '{_TITLES["soon"]}' ELSE '{_TITLES["month"]}' END AS title FROM c WHERE d <= 30""",
    "rating_conflicts": "SELECT p_type AS site, p_brand AS name, count(DISTINCT p_size) AS n_counts FROM part WHERE p_brand IS NOT NULL AND trim(p_brand) <> '' GROUP BY 1, 2 HAVING count(DISTINCT p_size) >= 2",
    "mail_auth": """SELECT s_suppkey AS site, s_suppkey % 3 <> 2 AS dmarc, s_suppkey % 3 = 1 AS dmarc_reports, array_to_string(list_filter([CASE WHEN s_suppkey % 4 IN (2, 3) THEN 'SPF' END, CASE WHEN s_suppkey % 3 = 2 THEN 'DMARC' END], lambda x: x IS NOT NULL), ' and ') AS missing_mail_auth FROM supplier""",
    "host_variant_facts": f"""WITH o AS (SELECT o_custkey AS site, o_orderkey % 3 AS f, {_pick_sql('o_orderkey // 3', (200, 200, 0, 404))} AS s FROM orders)
SELECT site, CAST(count(*) FILTER (s = 200 AND f = 0) AS INTEGER) AS variant_http, CAST(count(*) FILTER (s = 200 AND f = 2) AS INTEGER) AS variant_other, CAST(count(*) FILTER (s = 0) AS INTEGER) AS variant_down FROM o GROUP BY 1""",
    "feature_advantages": """WITH f AS (SELECT s_suppkey AS k, unnest(range(6)) AS i FROM supplier), p AS (SELECT *, CASE WHEN (k + i) % 5 = 0 THEN NULL ELSE (k * 3 + i) % 2 = 0 END AS present FROM f)
SELECT 'f' || i AS feature, CAST(k AS VARCHAR) AS site FROM p WHERE k <> 1 AND present AND i IN (SELECT i FROM p WHERE k = 1 AND NOT present)""",
    "keyword_overlap": "SELECT p_brand AS site, CAST(p_partkey AS INTEGER) AS place, p_type AS term, p_type IN (SELECT p_type FROM part WHERE p_brand = 'Brand#11') AS shared FROM part WHERE p_brand <> 'Brand#11'",
    "affiliate_kinds": f"SELECT o_orderkey AS k, {_pick_sql('o_orderkey', KINDS)} AS kind FROM orders",
}
