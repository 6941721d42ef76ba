"""Operators over captured probes: robots, sitemaps, agents, hosts, certificates, links, mail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelode.functions import urls

#: Crawlers of AI systems that robots.txt names, by role, fixed values.
ROBOT_ROLES = {
    "OAI-SearchBot": "search", "PerplexityBot": "search", "Claude-SearchBot": "search", "MistralAI-Index": "search", "meta-webindexer": "search", "Amzn-SearchBot": "search", "DuckAssistBot": "user",
    "ChatGPT-User": "user", "Claude-User": "user", "Perplexity-User": "user", "MistralAI-User": "user", "Amzn-User": "user", "GPTBot": "train", "ClaudeBot": "train", "CCBot": "train",
    "meta-externalagent": "train", "Amazonbot": "train", "Bytespider": "train", "MistralAI-Training": "train", "Google-Extended": "optout", "Applebot-Extended": "optout",
}
#: Headers that a page should send, fixed values.
SECURITY_HEADERS = ("strict-transport-security", "content-security-policy", "x-content-type-options", "x-frame-options", "referrer-policy", "permissions-policy")
#: Private files, with what their bodies begin with, fixed values.
EXPOSED = {"/.git/HEAD": "ref:", "/.env": "", "/.git/config": "[core]"}


def header(headers: Column, name: str) -> Column:
    """A header's value whatever its letter case, '' if it isn't sent."""
    hit = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.coalesce(F.try_element_at(hit, F.lit(1))["value"], F.lit(""))


def missing_headers(headers: Column) -> Column:
    """The wanted headers that aren't sent, in order."""
    sent = F.transform(F.map_keys(headers), lambda k: F.lower(k))
    return F.array_except(F.array(*map(F.lit, SECURITY_HEADERS)), sent)


def robots_rules(lines: DataFrame) -> DataFrame:
    """site, group_id, agent, is_allow, path of robots.txt lines (site, seq, line).

    A run of user-agent lines begins a group; comments and empty values are no rules. One file is one site's
    lines, so the window is as large as a file.
    """
    own = lines.withColumn("l", F.trim(F.regexp_replace("line", r"#.*$", "")))
    field = F.lower(F.trim(F.regexp_extract("l", r"^([A-Za-z-]+)\s*:", 1)))
    value = F.trim(F.regexp_extract("l", r"^[A-Za-z-]+\s*:(.*)$", 1))
    rows = own.select("site", "seq", field.alias("f"), value.alias("v")).where(F.col("f").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("site").orderBy("seq")
    starts = (F.col("f") == "user-agent") & (F.coalesce(F.lag("f").over(order), F.lit("")) != "user-agent")
    rows = rows.withColumn("start", starts.cast("int")).withColumn("group_id", F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    agents = rows.where("f = 'user-agent'").select("site", "group_id", F.lower("v").alias("agent")).distinct()
    paths = rows.where("f <> 'user-agent' and v <> ''").select("site", "group_id", (F.col("f") == "allow").alias("is_allow"), F.col("v").alias("path"))
    return agents.join(paths, ["site", "group_id"])


def robots_access(lines: DataFrame, agents: dict[str, str] | None = None) -> DataFrame:
    """site, agent, role, blocked: whether an agent may not fetch the root. Its own group counts, else that of '*'; allow wins."""
    roles = agents or ROBOT_ROLES
    rules = robots_rules(lines)
    own = rules.where(F.col("agent").isin(*(a.lower() for a in roles), "*"))
    root = F.rtrim("path", F.lit("*")) == "/"
    verdict = own.groupBy("site", "agent").agg((F.bool_or(root & ~F.col("is_allow")) & ~F.bool_or(root & F.col("is_allow"))).alias("blocked"))
    named = F.explode(F.array(*(F.struct(F.lit(a).alias("agent"), F.lit(r).alias("role")) for a, r in roles.items())))
    sites = lines.select("site").distinct().select("site", named.alias("x")).select("site", "x.agent", "x.role")
    star = verdict.where("agent = '*'").select("site", F.col("blocked").alias("star"))
    mine = verdict.where("agent <> '*'").select("site", F.col("agent").alias("key"), F.col("blocked").alias("mine"))
    joined = sites.withColumn("key", F.lower("agent")).join(mine, ["site", "key"], "left").join(star, "site", "left")
    return joined.select("site", "agent", "role", F.coalesce("mine", "star", F.lit(False)).alias("blocked"))


def sitemap_entries(files: DataFrame, text_col: str) -> DataFrame:
    """loc and lastmod (first ten characters, as text) of every <url> of sitemap files."""
    block = F.regexp_extract_all(text_col, F.lit(r"(?is)(<url\b.*?</url>)"), 1)
    keep = [c for c in files.columns if c != text_col]
    each = files.select(*keep, F.posexplode(block).alias("seq", "b"))
    inner = lambda tag: F.trim(F.regexp_extract("b", rf"(?is)<{tag}\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{tag}>", 1))
    return each.select(*keep, "seq", inner("loc").alias("loc"), F.nullif(F.substring(inner("lastmod"), 1, 10), F.lit("")).alias("lastmod"))


def sitemap_facts(entries: DataFrame, today: str) -> DataFrame:
    """Facts of sitemap entries (site, loc, lastmod): totals and dates. Dates are compared as text."""
    return entries.groupBy("site").agg(
        F.count("*").cast("int").alias("sitemap_urls"), F.count("lastmod").cast("int").alias("sitemap_with_lastmod"), F.count_distinct("lastmod").cast("int").alias("sitemap_lastmods"),
        F.count_if(F.col("lastmod") > today).cast("int").alias("sitemap_future"), (F.count("*") > 0).alias("sitemap_found"),
    )


def agent_verdicts(probes: DataFrame) -> DataFrame:
    """site, agent, role, verdict over up to two URLs (site, agent, role, url_no, status, mitigated): ok, the first refusal, or that on some pages."""
    one = F.when(F.col("status") == 402, "pay per crawl").when(F.col("mitigated"), "challenged").when(F.col("status").between(200, 399), "ok").when(F.col("status").isin(401, 403, 406, 429, 503), "refused").otherwise("no answer")
    per = probes.withColumn("v", one)
    got = per.groupBy("site", "agent", "role").agg(F.count_if(F.col("v") == "ok").alias("ok"), F.count("*").alias("n"), F.min_by("v", F.when(F.col("v") != "ok", F.col("url_no"))).alias("bad"))
    return got.select("site", "agent", "role", F.when(F.col("ok") == F.col("n"), "ok").when(F.col("ok") == 0, F.col("bad")).otherwise(F.concat("bad", F.lit(" on some pages"))).alias("verdict"))


def agent_facts(verdicts: DataFrame) -> DataFrame:
    refused = F.col("verdict").isin("refused", "challenged", "pay per crawl")
    return verdicts.groupBy("site").agg(
        F.count("*").cast("int").alias("agents"), F.count_if(F.col("verdict") == "ok").cast("int").alias("agents_ok"), F.count_if(refused & F.col("role").isin("search", "user")).cast("int").alias("agents_refused_answer"),
        F.count_if(refused & (F.col("role") == "train")).cast("int").alias("agents_refused_train"),
    )


def host_variants(captures: DataFrame) -> DataFrame:
    """Facts of captured variants of a site's address (site, canonical, final_url, status)."""
    ends = F.col("status") == 200
    return captures.groupBy("site").agg(
        F.count_if(ends & (urls.scheme("final_url") == "http")).cast("int").alias("variant_http"), F.count_if(ends & (urls.scheme("final_url") == "https") & (urls.host("final_url") != urls.host("canonical"))).cast("int").alias("variant_other"),
        F.count_if(F.col("status") == 0).cast("int").alias("variant_down"),
    )


def days_left(until: Column, now: Column) -> Column:
    """Whole days, rounded down also below zero."""
    return F.floor((F.unix_timestamp(until) - F.unix_timestamp(now)) / 86400).cast("int")


def classify_links(targets: DataFrame) -> DataFrame:
    """site, kind, n of sampled link targets (site, url, final_url, status, hops, canonical, noindex)."""
    moved = F.col("hops") > 0
    other = (F.col("canonical") != "") & (urls.norm_url("canonical") != urls.norm_url("final_url"))
    kind = (
        F.when(F.col("status").isin(404, 410), "broken").when(F.col("status") >= 500, "server error").when(moved & urls.trivial_redirect("url", "final_url"), "trivial redirect").when(moved, "redirect")
        .when(F.col("noindex"), "noindex").when(other, "non-canonical").otherwise("fine")
    )
    return targets.withColumn("kind", kind).groupBy("site", "kind").agg(F.count("*").alias("n"))


def orphan_templates(sitemap_urls: DataFrame, linked: DataFrame, least: int = 10) -> DataFrame:
    """Templates of a site with so many sitemap URLs, none of which any page links to (site, url in both)."""
    key = urls.norm_url("url")
    have = linked.select("site", key.alias("k")).distinct().withColumn("hit", F.lit(True))
    listed = sitemap_urls.select("site", key.alias("k"), urls.url_template("url").alias("template"))
    by = listed.join(have, ["site", "k"], "left").groupBy("site", "template").agg(F.count("*").alias("n_urls"), F.coalesce(F.bool_or("hit"), F.lit(False)).alias("linked"))
    return by.where((F.col("n_urls") >= least) & ~F.col("linked")).select("site", "template", "n_urls")


def mail_facts(answers: DataFrame) -> DataFrame:
    """Facts of DNS answers (site, kind in spf/dmarc, answers array; a null array is unknown)."""
    spf = F.exists("answers", lambda a: F.lower(a).startswith("v=spf1"))
    dmarc = F.exists("answers", lambda a: F.lower(a).startswith("v=dmarc1"))
    reports = F.exists("answers", lambda a: F.lower(a).contains("rua="))
    got = answers.groupBy("site").agg(F.bool_or(F.when(F.col("kind") == "spf", spf)).alias("spf"), F.bool_or(F.when(F.col("kind") == "dmarc", dmarc)).alias("dmarc"), F.bool_or(F.when(F.col("kind") == "dmarc", dmarc & reports)).alias("dmarc_reports"))
    lacks = F.array_compact(F.array(F.when(~F.col("spf"), "SPF"), F.when(~F.col("dmarc"), "DMARC")))
    return got.withColumn("missing_mail_auth", F.array_join(lacks, " and "))


def affiliate_facts(links: DataFrame) -> DataFrame:
    """analysed and affiliate_pages of a site (links: site, page_id, status, url). A URL on more than half of the pages is furniture and doesn't count."""
    pages = links.where("status = 200")
    total = pages.groupBy("site").agg(F.count_distinct("page_id").alias("analysed"))
    tracked = pages.where(urls.affiliate_kind("url") != "").select("site", "page_id", F.regexp_replace("url", "#.*$", "").alias("u")).distinct()
    per = tracked.groupBy("site", "u").agg(F.count("*").alias("n")).join(total, "site").where(F.col("n") <= F.col("analysed") * 0.5)
    hits = tracked.join(per.select("site", "u"), ["site", "u"]).groupBy("site").agg(F.count_distinct("page_id").alias("affiliate_pages"))
    return total.join(hits, "site", "left").select("site", F.col("analysed").cast("int").alias("analysed"), F.coalesce("affiliate_pages", F.lit(0)).cast("int").alias("affiliate_pages"))


def rating_conflicts(entities: DataFrame) -> DataFrame:
    """Names of a site that declare two or more review counts (site, name, reviews)."""
    named = entities.where("name is not null and trim(name) <> ''")
    return named.groupBy("site", "name").agg(F.count_distinct("reviews").alias("n_counts")).where("n_counts >= 2")


def speed_facts(results: DataFrame) -> DataFrame:
    """site, psi_status, psi_score and measured metrics of speed-test payloads (site, status, payload JSON)."""
    v = F.try_parse_json("payload")
    got = lambda p, t: F.try_variant_get(v, p, t)
    score = got("$.lighthouseResult.categories.performance.score", "double")
    return results.select(
        "site", F.col("status").alias("psi_status"), F.rint(score * 100).cast("int").alias("psi_score"), (F.col("status").between(200, 299) & score.isNull()).alias("psi_invalid"),
        got("$.loadingExperience.overall_category", "string").alias("field_category"), got("$.loadingExperience.metrics.LARGEST_CONTENTFUL_PAINT_MS.percentile", "double").alias("lcp_ms"),
        got("$.loadingExperience.metrics.INTERACTION_TO_NEXT_PAINT.percentile", "double").alias("inp_ms"), got("$.loadingExperience.metrics.CUMULATIVE_LAYOUT_SHIFT_SCORE.percentile", "double").alias("cls"),
    )
