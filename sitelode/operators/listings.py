"""Small relational steps of an audit: captures met with crawl lists, samples, summaries for reading, and ordered reports.

Orders are total (the last key is unique or the row itself), so a report reads the same in every run. A limit stands
only where the report is a top-k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelode.functions import urls
from sitelode.operators import captures, scoring

#: Types that say how a page is built rather than what it is about, fixed values.
STRUCTURAL_TYPES = ("WebSite", "WebPage", "BreadcrumbList", "ListItem", "ImageObject", "SearchAction", "EntryPoint", "SiteNavigationElement")
#: Answers to a bot that a browser may not get, fixed values.
REFUSALS = (401, 403, 406, 429)
#: Half a year in seconds: transport security that lasts less is weak.
HALF_YEAR = 15_552_000


def _bare(url: str) -> Column:
    return F.rtrim(url, F.lit("/"))


# -- captures and crawl lists --------------------------------------------------------------------------


def with_fallback(bot: DataFrame, browser: DataFrame) -> DataFrame:
    """Each capture of ``bot``, or that of ``browser`` of the same URL where the bot was refused and the browser got 200; ``ua_fallback`` says which (both: url, status, ...)."""
    rest = [c for c in bot.columns if c != "url"]
    other = browser.where("status = 200").groupBy("url").agg(F.max(F.struct(*rest)).alias("_b"))
    met = bot.join(other, "url", "left").withColumn("ua_fallback", F.col("status").isin(*REFUSALS) & F.col("_b").isNotNull())
    return met.select("url", *(F.when(F.col("ua_fallback"), F.col("_b")[c]).otherwise(F.col(c)).alias(c) for c in rest), "ua_fallback")


def crawled(listed: DataFrame, captured: DataFrame) -> DataFrame:
    """The crawl list with what was captured of each URL; a URL without capture has status 0 (listed: site, url, ord; captured: url, status, ...)."""
    return listed.join(captured, "url", "left").withColumn("status", F.coalesce("status", F.lit(0)))


def uncrawled(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Link targets that weren't crawled, each once, the first spelling of it (candidates: site, url, ord; known: site, url); a trailing slash doesn't matter."""
    seen = known.select("site", _bare("url").alias("_k")).distinct()
    fresh = candidates.withColumn("_k", _bare("url")).join(seen, ["site", "_k"], "left_anti")
    return fresh.groupBy("site", "_k").agg(F.min_by("url", "ord").alias("url"), F.min("ord").alias("ord")).drop("_k")


def named_agents(verdicts: DataFrame, lines: DataFrame) -> DataFrame:
    """Verdicts on the agents that a site's robots file names (verdicts: site, agent, ...; lines: site, seq, line)."""
    named = captures.robots_rules(lines).select("site", F.col("agent").alias("_a")).distinct()
    return verdicts.withColumn("_a", F.lower("agent")).join(named, ["site", "_a"], "left_semi").drop("_a")


def image_sample(images: DataFrame) -> DataFrame:
    """One image of each top-level directory of a site, the first one (site, url, ord); images of other hosts are the caller's to leave out."""
    top = F.regexp_extract(urls.path("url"), "^/([^/]*)", 1)
    return images.groupBy("site", top.alias("directory")).agg(F.min_by("url", "ord").alias("url"))


def font_payload(fonts: DataFrame) -> DataFrame:
    """Kilobytes of a site's distinct font files (site, url, status, bytes); a file of several stylesheets is one download."""
    once = fonts.where("status = 200").groupBy("site", "url").agg(F.max("bytes").alias("bytes"))
    return once.groupBy("site").agg(F.expr("CAST(sum(bytes) DIV 1024 AS INT)").alias("font_kb"), F.count("*").alias("n_files"))


# -- values ----------------------------------------------------------------------------------------------


def media_matches(media: Column, width: int = 412) -> Column:
    """Whether no width clause of a media query excludes a screen so wide; em and rem are 16 pixels."""
    clauses = F.regexp_extract_all(F.coalesce(media, F.lit("")), F.lit(r"(?i)((?:min|max)-width\s*:\s*[0-9.]+\s*[a-z]*)"), 1)

    def fits(c: Column) -> Column:
        size = F.regexp_extract(c, r"([0-9.]+)", 1).try_cast("double") * F.when(F.lower(c).rlike("r?em$"), 16).otherwise(1)
        return F.coalesce(F.when(F.lower(c).startswith("min"), size <= width).otherwise(size >= width), F.lit(True))

    return F.forall(clauses, fits)


def hsts_quality(header: Column) -> Column:
    """What a transport-security header lacks, or 'strong'; null if it isn't sent."""
    age = F.coalesce(F.regexp_extract(header, r"max-age=(\d+)", 1).try_cast("bigint"), F.lit(0))
    notes = F.array_compact(F.array(F.when(age < HALF_YEAR, "max-age under 6 months"), F.when(~F.lower(header).contains("includesubdomains"), "no includeSubDomains")))
    return F.when(header != "", F.when(F.size(notes) == 0, "strong").otherwise(F.array_join(notes, ", ")))


def address_text(node: Column) -> Column:
    """The address of a structured-data node (JSON) in one line."""
    own = F.get_json_object(node, "$.address")
    parts = [F.nullif(F.get_json_object(own, f"$.{k}"), F.lit("")) for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")]
    return F.when(own.startswith("{"), F.concat_ws(", ", *parts)).otherwise(F.coalesce(own, F.lit("")))


def rating_text(node: Column) -> Column:
    """The rating of a structured-data node (JSON) with its number of reviews; null without one."""
    value = F.nullif(F.get_json_object(node, "$.aggregateRating.ratingValue"), F.lit(""))
    count = F.coalesce(F.get_json_object(node, "$.aggregateRating.reviewCount"), F.get_json_object(node, "$.aggregateRating.ratingCount"))
    return F.concat(value, F.when(F.coalesce(count, F.lit("0")) != "0", F.concat(F.lit(" from "), count, F.lit(" reviews"))).otherwise(""))


def api_error(body: Column) -> Column:
    """(message, api_status, reason, enable_url) of an error answer as JSON."""
    v = F.try_parse_json(body)
    get = lambda p, t="string": F.try_variant_get(v, p, t)
    message = F.trim(F.coalesce(get("$.error.message"), get("$.raw"), F.lit("")))
    details = F.filter(get("$.error.details", "array<struct<reason:string,metadata:struct<activationUrl:string>>>"), lambda d: d["reason"] != "")
    last = F.try_element_at(details, F.lit(-1))
    linked = F.nullif(F.regexp_replace(F.regexp_extract(message, r"https://console\.(?:developers|cloud)\.google\.com/apis/api/[^\s\"']+", 0), r"[.,;)]+$", ""), F.lit(""))
    reason = F.coalesce(last["reason"], F.when(message.contains("has not been used in project"), "SERVICE_DISABLED"))
    return F.struct(message.alias("message"), get("$.error.status").alias("api_status"), reason.alias("reason"), F.coalesce(F.nullif(last["metadata"]["activationUrl"], F.lit("")), linked).alias("enable_url"))


# -- summaries -------------------------------------------------------------------------------------------


def confidence(pages: DataFrame, psi: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """site, confidence: high with a speed test, medium without or with unseen templates, low if most pages (or all deep ones) didn't load.

    ``pages`` has site, status, source; ``psi`` has site and psi_status ('ok' or another); ``gaps`` has the sites with unseen templates.
    """
    deep = F.col("source") != "sweep"
    by = pages.groupBy("site").agg(F.count("*").alias("n"), F.count_if(F.col("status") == 200).alias("loaded"), F.count_if(deep).alias("deep"), F.count_if(deep & (F.col("status") != 0)).alias("answered"))
    met = by.join(psi.select("site", (F.col("psi_status") == "ok").alias("_ok")), "site", "left")
    met = met.join(gaps.select("site").distinct().withColumn("_gap", F.lit(True)), "site", "left") if gaps is not None else met.withColumn("_gap", F.lit(None).cast("boolean"))
    low = (F.col("deep") == 0) | (F.col("answered") == 0) | (F.col("loaded") < F.greatest(F.lit(1), F.expr("n DIV 2")))
    return met.select("site", F.when(low, "low").when(~F.coalesce("_ok", F.lit(False)) | F.coalesce("_gap", F.lit(False)), "medium").otherwise("high").alias("confidence"))


def answer_readiness(pages: DataFrame) -> DataFrame:
    """What makes a page quotable (needs ``doc``, url, words, dated, article_node): questions among its headings, lists, tables, date and four types, structural ones last."""
    heads = F.filter("doc.headings", lambda h: h["level"].isin(2, 3))
    question = lambda h: F.trim(h["text"]).rlike(r"(?i)\?\s*$|^(how|what|why|when|where|who|which|can|do|does|is|are|should)\b")
    ranked = F.array_sort(F.transform("doc.jsonld_types", lambda t: F.struct(t.isin(*STRUCTURAL_TYPES).alias("s"), t.alias("t"))))
    types = F.transform(F.slice(ranked, 1, 4), lambda x: x["t"])
    return pages.select(
        "url", "words", F.size(F.filter(heads, question)).alias("question_headings"), F.size(heads).alias("subheadings"), F.col("doc.list_count").alias("lists"), F.col("doc.table_count").alias("tables"),
        F.when(F.col("dated"), "visible").when(F.exists("doc.jsonld", lambda x: x.rlike('"date(Published|Modified)"')), "schema only").otherwise("none").alias("dated"), F.coalesce(F.nullif(F.array_join(types, ", "), F.lit("")), F.lit("none")).alias("schema"),
    )


def keyword_insights(terms: DataFrame) -> DataFrame:
    """site, well_placed, missing_from, buried, phrases: what the ranked key phrases of a site tell (site, place, term, zones, body_count)."""
    top = terms.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("place", "term", "zones", "body_count"))).alias("l"))  # a top-k report
    first = F.col("l")[0]["zones"]
    has = lambda zones, z: F.array_contains(zones, z)
    buried = F.filter(F.slice("l", F.lit(2), F.size("l")), lambda t: (t["body_count"] >= 2) & ~has(t["zones"], "title") & ~has(t["zones"], "h1"))
    names = lambda xs, n: F.transform(F.slice(xs, 1, n), lambda t: t["term"])
    missing = F.array_compact(F.array(F.when(~has(first, "title"), F.lit("title")), F.when(~has(first, "h1"), F.lit("h1"))))
    return top.select("site", (F.size(missing) == 0).alias("well_placed"), missing.alias("missing_from"), names(buried, 4).alias("buried"), names(F.filter("l", lambda t: t["term"].contains(" ")), 3).alias("phrases"))


def feature_matrix(features: DataFrame, sites: list[str]) -> DataFrame:
    """A row for each feature and a column with its value for each of a few sites (feature, site, value)."""
    return features.groupBy("feature").pivot("site", sites).agg(F.first("value"))


# -- ordered reports -------------------------------------------------------------------------------------


def ordered_findings(findings: DataFrame) -> DataFrame:
    """By severity, then impact, then as they came (severity, impact, ord)."""
    return findings.orderBy(scoring.severity_rank("severity"), F.desc("impact"), "ord")


def ordered_sweep(summary: DataFrame) -> DataFrame:
    """By severity, then how many pages (severity, n, title)."""
    return summary.orderBy(scoring.severity_rank("severity"), F.desc("n"), "site", "category", "title")


def ordered_kinds(kinds: DataFrame) -> DataFrame:
    """By severity, category and title (severity, category, key)."""
    return kinds.orderBy(scoring.severity_rank("severity"), "category", "key")


def ordered_places(places: DataFrame) -> DataFrame:
    """By number of queries, best place and title (n_queries, best_pos, place)."""
    return places.orderBy(F.desc("n_queries"), F.asc_nulls_last("best_pos"), "place")


def ordered_features(features: DataFrame) -> DataFrame:
    """Domains by how often they are in any feature (domain, feature, n)."""
    total = features.groupBy("domain").agg(F.sum("n").alias("_total"))
    return features.join(total, "domain").orderBy(F.desc("_total"), "domain", "feature").drop("_total")


def ordered_search_rows(rows: DataFrame) -> DataFrame:
    """By impressions, then clicks (impressions, clicks)."""
    return rows.orderBy(F.desc("impressions"), F.desc("clicks"), *(c for c in rows.columns if c not in ("impressions", "clicks")))


def owned_candidates(domains: DataFrame, most: int = 12) -> DataFrame:
    """The first domains to look at that may belong to a site's owner, declared ones first (site, domain, declared; a top-k report)."""
    first = domains.groupBy("site", "domain").agg(F.bool_or("declared").alias("declared"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((~F.col("declared")).alias("later"), "domain"))), 1, most)
    return first.groupBy("site").agg(best.alias("x")).select("site", F.posexplode("x").alias("i", "x")).select("site", (F.col("i") + 1).alias("place"), "x.domain", (~F.col("x.later")).alias("declared"))
