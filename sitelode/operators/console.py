"""Rules over exported analytics and search-console data, captured as JSON items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelode.functions import text, urls

#: Retention settings that keep event data long enough, fixed values.
GOOD_RETENTION = ("FOURTEEN_MONTHS", "TWENTY_SIX_MONTHS", "THIRTY_EIGHT_MONTHS", "FIFTY_MONTHS")
STALE_DAYS = 30
ANALYTICS, SEARCH = "analytics", "search-console"


def pick_search_property(properties: DataFrame, domain: str) -> DataFrame:
    """The property to read (column ``property``): the shortest domain property that covers the domain, else the longest URL prefix."""
    name = F.regexp_replace("property", "^sc-domain:", "")
    own = properties.withColumn("d", F.when(F.col("property").startswith("sc-domain:"), name))
    covers = F.when(F.col("d").isNotNull(), urls.host_matches(F.lit(domain), F.col("d"))).otherwise(urls.normalize_domain("property") == domain)
    fit = own.where(covers)
    key = F.struct(F.col("d").isNull().alias("url"), F.when(F.col("d").isNotNull(), F.length("property")).otherwise(-F.length("property")).alias("len"), "property")
    return fit.agg(F.min(key)["property"].alias("property")).where("property is not null")


def period_compare(rows: DataFrame, keys: list[str], day: Column, today: Column, days: int) -> DataFrame:
    """Clicks and impressions of the last window and the one before it, by key."""
    a, b, c, d = text.date_windows(days, today)
    now, before = day.between(a, b), day.between(c, d)
    total = lambda col, when: F.sum(F.when(when, F.col(col)).otherwise(0))
    return rows.where(now | before).groupBy(*keys).agg(total("clicks", now).alias("clicks"), total("clicks", before).alias("clicks_before"), total("impressions", now).alias("impressions"), total("impressions", before).alias("impressions_before"))


def host_variant_impressions(rows: DataFrame, site: Column) -> DataFrame:
    """Impressions of pages on another host or scheme than the site's, by host and scheme."""
    own = rows.where("impressions > 0").select(urls.scheme("page").alias("scheme"), urls.host("page").alias("host"), site.alias("site"), "impressions")
    return own.where((F.col("host") != urls.host("site")) | (F.col("scheme") != urls.scheme("site"))).groupBy("site", "scheme", "host").agg(F.sum("impressions").alias("impressions"))


def evaluate(items: DataFrame, today: Column, launched: Column | None = None) -> DataFrame:
    """Findings of one property's captured items.

    ``items`` has property, name, ok, status, body (JSON). Names: retention, key_events, custom_dimensions,
    signals, identity, streams, data_report, sitemaps, inspections, pages, queries. A missing item tells nothing.
    """
    v = F.try_parse_json("body")
    get = lambda p, t="string": F.try_variant_get(v, p, t)
    size = lambda p: F.size(F.coalesce(F.try_variant_get(v, p, "array<variant>"), F.array().cast("array<variant>")))
    at = lambda n: F.col("name") == n
    fact = lambda n, c: F.max(F.when(at(n) & F.col("ok"), c))
    lists = lambda n, p, kind: F.max(F.when(at(n) & F.col("ok"), F.try_variant_get(v, p, f"array<{kind}>")))
    facts = items.groupBy("property").agg(
        fact("retention", get("$.eventDataRetention")).alias("retention"), fact("retention", F.lit(1)).alias("has_retention"), fact("key_events", F.lit(1)).alias("has_key_events"), lists("key_events", "$.keyEvents", "struct<eventName:string>").alias("key_events"),
        fact("custom_dimensions", size("$.customDimensions")).alias("dimensions"), fact("signals", get("$.state")).alias("signals"), fact("identity", get("$.reportingIdentity")).alias("identity"),
        lists("streams", "$.dataStreams", "struct<defaultUri:string>").alias("streams"), fact("streams", get("$.site")).alias("site"), F.max(F.when(at("data_report") & ~F.col("ok"), F.coalesce(get("$.reason"), F.lit("other")))).alias("data_error"),
        fact("sitemaps", size("$.sitemap")).alias("n_sitemaps"), lists("sitemaps", "$.sitemap", "struct<path:string,lastDownloaded:string,lastSubmitted:string>").alias("sitemaps"),
        lists("inspections", "$.items", "struct<url:string,coverageState:string,lastCrawlTime:string>").alias("inspections"), fact("pages", get("$.impressions", "double")).alias("impressions"), fact("queries", get("$.rows", "int")).alias("query_rows"),
        fact("pages", get("$.variant_impressions", "double")).alias("variant_impressions"),
    )
    seen = lambda s: F.coalesce(text.parse_time(s["lastDownloaded"]), text.parse_time(s["lastSubmitted"]))
    stale = F.exists("sitemaps", lambda s: seen(s).isNull() | (F.datediff(today, F.to_date(seen(s))) > STALE_DAYS))
    never = F.exists("inspections", lambda i: i["coverageState"] == "URL is unknown to Google")
    old = F.exists("inspections", lambda i: text.parse_time(i["lastCrawlTime"]) < launched) if launched is not None else F.lit(False)
    leads = F.exists("key_events", lambda e: e["eventName"] != "purchase")
    rules = (
        (F.col("has_retention").isNotNull() & ~F.coalesce(F.col("retention").isin(*GOOD_RETENTION), F.lit(False)), "HIGH", ANALYTICS, F.concat(F.lit("GA4 event data retention is "), F.coalesce("retention", F.lit("unset")))),
        (F.col("has_key_events").isNotNull() & ~F.coalesce(leads, F.lit(False)), "HIGH", ANALYTICS, F.lit("No GA4 key event for leads")),
        (F.col("dimensions") == 0, "INFO", ANALYTICS, F.lit("No GA4 custom dimensions registered")),
        ((F.col("signals") == "GOOGLE_SIGNALS_ENABLED") & (F.col("identity") == "BLENDED"), "LOW", ANALYTICS, F.lit("Google signals on with Blended reporting identity (thresholding)")),
        (F.exists("streams", lambda s: urls.normalize_domain(s["defaultUri"]) != urls.normalize_domain("site")), "LOW", ANALYTICS, F.lit("GA4 web stream URL differs from the site host")),
        (F.col("data_error") == "SERVICE_DISABLED", "INFO", ANALYTICS, F.lit("GA4 Data API is not enabled for the service account's project")),
        (F.col("data_error") != "SERVICE_DISABLED", "INFO", ANALYTICS, F.lit("GA4 Data API reports could not be read")),
        (F.col("n_sitemaps") == 0, "HIGH", SEARCH, F.lit("No sitemap submitted to Search Console")),
        (stale, "HIGH", SEARCH, F.lit("Sitemap not fetched by Google in over 30 days")),
        (never, "HIGH", SEARCH, F.lit("Pages Google has never seen")),
        (old, "HIGH", SEARCH, F.lit("Google's copy predates the launch")),
        (F.col("variant_impressions") > 0, "MEDIUM", SEARCH, F.lit("Non-canonical host variants are collecting impressions")),
        ((F.col("impressions") > 0) & (F.coalesce("query_rows", F.lit(0)) == 0), "INFO", SEARCH, F.lit("No queries visible (anonymized by Search Console)")),
    )
    fired = F.filter(F.array(*(F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(a).alias("area"), t.alias("title"))) for c, s, a, t in rules)), lambda x: x.isNotNull())
    return facts.select("property", F.explode(fired).alias("x")).select("property", "x.*")
