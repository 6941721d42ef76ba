"""Who fills the result pages: tallies, classes, shortlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelode.functions import text, urls
from sitelode.operators import listings
from sitelode.session import table
from sitelode.sources import result_pages

TOP = 15
SHORTLIST = 8

#: Domains (with a dot) and names of sites by class, in order, fixed values.
CLASSES = (
    ("marketplace", ("tripadvisor", "viator", "getyourguide", "expedia", "travelocity", "booking", "airbnb", "groupon", "peek", "yelp", "klook", "amazon", "etsy", "pelago", "tiqets", "headout", "civitatis", "musement")),
    ("social", ("facebook", "instagram", "tiktok", "youtube", "reddit", "pinterest", "twitter", "linkedin", "x.com", "youtu.be")),
    ("reference", ("wikipedia", "wikitravel", "wikivoyage")),
    ("news", ("azfamily", "kpnx", "azcentral")),
)
#: Parts of names that tell of news sites and directories, broadcasting networks, and names of classes as callers may write them. Fixed values.
NEWS_HINTS = ("news", "times", "tribune", "herald", "gazette")
DIRECTORY_HINTS = ("visit", "tourism", "downtown", "chamber")
NETWORKS = ("fox", "abc", "nbc", "cbs")
ALIASES = {"ota": "marketplace", "marketplace/ota": "marketplace", "aggregator": "marketplace", "social/video": "social", "video": "social", "dmo": "directory", "directory/dmo": "directory", "competitor": "business"}


def station(name: Column) -> Column:
    """Whether a name is a broadcaster's or a paper's: a network with a channel, a call sign before 'tv', or an ending in 'sun'."""
    channel = F.substring(name, 4, 63)
    network = F.substring(name, 1, 3).isin(*NETWORKS) & ((channel == "") | (channel == "news") | channel.rlike("^[0-9]+[a-z]*$"))
    sign = F.regexp_extract(name, "^([a-z]+)tv[0-9]*$", 1)
    return network | (F.substring(sign, 1, 1).isin("k", "w") & F.length(sign).between(2, 4)) | name.endswith("sun")


def classify(domain: Column, own: tuple[str, ...] = (), overrides: dict[str, str] | None = None) -> Column:
    """The class of a normalized domain: own, overrides (longest first), table, .edu, news, directory, .org/.gov, business."""
    lits = lambda xs: F.array(*map(F.lit, xs))

    def of(x: Column) -> Column:
        d, name = x["d"], x["n"]
        words = F.split(name, "-")
        out = F.when(F.exists(lits(own), lambda o: urls.host_matches(d, o)), "own") if own else F.when(F.lit(False), "")
        for o, c in sorted((overrides or {}).items(), key=lambda y: -len(y[0])):
            out = out.when(urls.host_matches(d, o), ALIASES.get(c.strip().lower(), c.strip().lower()))
        for c, entries in CLASSES:
            dotted, tokens = [e for e in entries if "." in e], [e for e in entries if "." not in e]
            hit = F.arrays_overlap(words, lits(tokens))
            out = out.when(hit | F.exists(lits(dotted), lambda o: urls.host_matches(d, o)) if dotted else hit, c)
        out = out.when(d.endswith(".edu") | d.contains(".edu."), "reference")
        out = out.when(F.arrays_overlap(words, lits(NEWS_HINTS)) | F.exists(lits(NEWS_HINTS), lambda h: name.endswith(h)) | station(name), "news")
        hinted = F.arrays_overlap(words, lits(DIRECTORY_HINTS)) | F.exists(lits(DIRECTORY_HINTS), lambda h: name.startswith(h) | name.endswith(h))
        out = out.when(~name.rlike("tour(?!ism)") & hinted, "directory")
        return out.when(F.exists(lits((".org", ".gov")), lambda t: d.endswith(t) | d.contains(F.concat(t, F.lit(".")))), "directory").otherwise("business")

    # Bound once, so that the domain's own expression isn't repeated for each rule.
    named = F.transform(F.array(domain), lambda d: F.struct(d.alias("d"), urls.site_name(d).alias("n")))
    return F.transform(named, of)[0]


def organic_top(organic: DataFrame, top: int = TOP) -> DataFrame:
    """Each record's results without repeated URLs (the first one stays), the first ``top`` of them."""
    own = organic.where("url is not null and url <> ''").withColumn("k", urls.url_key("url"))
    first = own.groupBy("serp_id", "k").agg(F.min_by(F.struct("query", "position", "url", "domain"), F.struct("seq", "organic_id")).alias("r"), F.min(F.struct("seq", "organic_id")).alias("o"))
    rank = F.row_number().over(Window.partitionBy("serp_id").orderBy("o"))  # top-k: limited before the shuffle
    return first.withColumn("rn", rank).where(F.col("rn") <= top).select("serp_id", "r.*", F.col("o.seq").alias("seq"), F.col("o.organic_id").alias("organic_id"), "rn")


def tally_domains(results: DataFrame) -> DataFrame:
    """A row for each domain: queries, appearances, best place and URL, mean place, visibility."""
    own = results.withColumn("domain", urls.normalize_domain("domain")).where("domain <> ''")
    p = F.when(F.col("position") > 0, F.col("position"))
    return own.groupBy("domain").agg(
        F.count_distinct(F.lower("query")).alias("n_queries"),
        F.count("*").alias("appearances"),
        F.min(p).alias("best_pos"),
        F.min_by("url", F.struct(p.isNull(), p, "organic_id")).alias("best_url"),
        F.round(F.avg(p), 6).alias("avg_pos"),
        F.sum(text.visibility("position")).cast("double").alias("score"),
    )


def organic_top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organic_top(table(spark, sf_dir, "serp_organic")).select("serp_id", "rn", "organic_id", "url", "position")


def domain_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally_domains(organic_top(table(spark, sf_dir, "serp_organic")))


def domain_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of each domain for each query."""
    own = organic_top(table(spark, sf_dir, "serp_organic")).withColumn("domain", urls.normalize_domain("domain")).where("domain <> ''")
    return own.groupBy("domain", F.lower("query").alias("query_key")).agg(F.count("*").alias("n_results"), F.min("position").alias("best_pos"), F.count_distinct("position").alias("n_positions"))


def classified_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "serp_organic").select(urls.normalize_domain("domain").alias("domain")).where("domain <> ''").distinct()
    # The tables' own entries, so that every class occurs.
    extra = [f"{e}.com" if "." not in e else e for _, own in CLASSES for e in own] + ["a.edu", "b.edu.au", "daily-news.com", "capetimes.co.uk", "fox10.com", "wbtv.com", "citysun.com", "visitx.com", "downtowntours.com", "tourism-x.com", "x.org", "y.gov.uk", "booking.rivaltours.com", "my-yelp.com"]
    return names.union(names.sparkSession.createDataFrame([(d,) for d in extra], "domain string")).distinct().select("domain", classify(F.col("domain"), ("hollow-aquarium.example",), {"copper-theatre.example": "OTA"}).alias("category"))


def shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The business domains of the highest visibility (a top-k report)."""
    ranked = domain_tally(spark, sf_dir).where(classify(F.col("domain")) == "business")
    return ranked.orderBy(F.desc("score"), F.desc("n_queries"), F.asc_nulls_last("best_pos"), "domain").limit(SHORTLIST).select("domain", "score", "n_queries", "best_pos")


OWN = ("hollow-aquarium.example", "example", "nowhere.test")


def own_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own domains with the results at or below them, zeros for those without."""
    tally = domain_tally(spark, sf_dir).select("domain", "appearances", "score")
    own = spark.createDataFrame([(d,) for d in OWN], "own string")
    hit = tally.withColumn("own", F.explode(F.filter(F.array(*map(F.lit, OWN)), lambda o: urls.host_matches(F.col("domain"), o))))
    sums = hit.groupBy("own").agg(F.sum("appearances").alias("appearances"), F.sum(F.col("score").cast("decimal(20,12)")).alias("score"))
    return own.join(F.broadcast(sums), "own", "left").select("own", F.coalesce("appearances", F.lit(0)).cast("bigint").alias("appearances"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))


def query_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct queries but for letter case, the first spelling of each."""
    return table(spark, sf_dir, "serp_records").where("query is not null").groupBy(F.lower("query").alias("query_key")).agg(F.min_by("query", "serp_id").alias("query"), F.count("*").alias("n_records"))


def not_captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries none of whose records holds a result."""
    records = table(spark, sf_dir, "serp_records").where("query is not null").select("serp_id", F.lower("query").alias("query_key"))
    captured = table(spark, sf_dir, "serp_organic").where("url is not null").select(F.lower("query").alias("query_key")).distinct()
    return records.select("query_key").distinct().join(captured, "query_key", "left_anti")


def local_pack_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each place: first title and domain, best place, last rating, most reviews."""
    local = table(spark, sf_dir, "serp_local").where("title is not null and trim(title) <> ''").withColumn("place", F.lower(F.trim("title")))
    at = F.struct("serp_id", "seq")
    return local.groupBy("place").agg(
        F.count_distinct(F.lower("query")).alias("n_queries"),
        F.count("*").alias("appearances"),
        F.min(F.when(F.col("position") > 0, F.col("position"))).alias("best_pos"),
        F.max_by(F.col("rating"), F.when(F.col("rating").isNotNull(), F.struct("serp_id", "seq", "rating"))).alias("rating"),
        F.max("reviews").alias("reviews"),
        F.min_by(F.col("domain"), F.when(F.col("domain") != "", F.struct("serp_id", "seq", "domain"))).alias("domain"),
        F.min(at)["serp_id"].alias("first_serp"),
    )


def engine_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, results and top-three results by engine and way of parsing."""
    records = table(spark, sf_dir, "serp_records").select("serp_id", "engine_key", "parse_mode")
    per = table(spark, sf_dir, "serp_organic").groupBy("serp_id").agg(F.count("*").alias("n"), F.count_if(F.col("position").between(1, 3)).alias("top3"))
    return records.join(per, "serp_id", "left").groupBy("engine_key", "parse_mode").agg(F.count("*").alias("n_records"), F.sum(F.coalesce("n", F.lit(0))).alias("n_results"), F.sum(F.coalesce("top3", F.lit(0))).alias("n_top3"))


def stop_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events before the second failure in a row, as a capture loop that gives up then."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("failed"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    stop = F.min(F.when(F.col("failed") & F.col("before"), F.struct("ts", "event_id"))).alias("stop")
    marked = events.withColumn("before", F.coalesce(F.lag("failed").over(order), F.lit(False)))
    stops = marked.groupBy("user_id").agg(stop)
    kept = events.join(stops, "user_id").where(F.col("stop").isNull() | (F.struct("ts", "event_id") < F.col("stop")))
    return kept.groupBy("user_id").agg(F.count("*").alias("n_kept"))


def result_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as blocks of a result page each and read again."""
    o = table(spark, sf_dir, "serp_organic").where("url rlike '^https?://'")
    less = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    page = F.concat(F.lit('<section id="mixed-main"><div data-type="web" data-pos="'), "seq", F.lit('"><a href="'), less(F.col("url")), F.lit('"><b class="title">'), less(F.col("title")), F.lit("</b></a><img></div></section>"))
    rows = result_pages.flat_rows(o.select("organic_id", page.alias("html")), "organic_id", "html")
    return rows.select("organic_id", "kind", "parse_mode", "position", "url", "title", "slot")


def ordered_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of local packs in the order of a report."""
    return listings.ordered_places(local_pack_tally(spark, sf_dir)).select("place", "n_queries", "best_pos")


QUERIES = {f.__name__: f for f in (result_page_rows, ordered_places, domain_tally, organic_top_rows, domain_positions, classified_domains, shortlist, own_domains, query_list, not_captured, local_pack_tally, engine_share, stop_rule)}

_ND = r"regexp_replace(regexp_replace(regexp_extract(lower(regexp_replace({0}, '^[\s ]+|[\s ]+$', '', 'g')), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:@]*)', 1), '^\.+|\.+$', '', 'g'), '^www\.', '')"
_TOP = rf"""
k AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') AS k FROM serp_organic WHERE url IS NOT NULL AND url <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY serp_id, k ORDER BY seq, organic_id) AS a FROM k),
top AS (SELECT *, {_ND.format("domain")} AS dom FROM (SELECT *, row_number() OVER (PARTITION BY serp_id ORDER BY seq, organic_id) AS rn FROM f WHERE a = 1) WHERE rn <= {TOP})"""
_TALLY = rf"""{_TOP},
tally AS (SELECT dom AS domain, count(DISTINCT lower(query)) AS n_queries, count(*) AS appearances, min(CASE WHEN position > 0 THEN position END) AS best_pos,
 first(url ORDER BY position IS NULL OR position <= 0, CASE WHEN position > 0 THEN position END, organic_id) AS best_url, round(avg(CASE WHEN position > 0 THEN position END), 6) AS avg_pos,
 CAST(sum(CASE WHEN position > 0 THEN CAST(1.0::DOUBLE / position AS DECIMAL(20,12)) ELSE 0 END) AS DOUBLE) AS score FROM top WHERE dom <> '' GROUP BY dom)"""
_NAME = "CASE WHEN len(p) >= 3 AND len(p[-1]) = 2 AND p[-2] IN (" + ",".join(f"'{x}'" for x in urls.SITE_SECOND_LEVEL) + ") THEN p[-3] WHEN len(p) >= 2 THEN p[-2] ELSE p[1] END"


def _match(d: str) -> str:
    return f"(domain = '{d}' OR ends_with(domain, '.{d}'))"


def _class_sql(own: tuple[str, ...] = (), overrides: dict[str, str] | None = None) -> str:
    w = [f"WHEN {_match(o)} THEN 'own'" for o in own] + [f"WHEN {_match(d)} THEN '{c}'" for d, c in (overrides or {}).items()]
    for c, entries in CLASSES:
        w += [f"WHEN {_match(e)} THEN '{c}'" if "." in e else f"WHEN list_contains(words, '{e}') THEN '{c}'" for e in entries]
    w.append("WHEN ends_with(domain, '.edu') OR contains(domain, '.edu.') THEN 'reference'")
    w += [f"WHEN list_contains(words, '{h}') OR ends_with(name, '{h}') THEN 'news'" for h in NEWS_HINTS]
    networks = ",".join(f"'{n}'" for n in NETWORKS)
    w.append(f"WHEN (name[:3] IN ({networks}) AND (name[4:] IN ('', 'news') OR regexp_matches(name[4:], '^[0-9]+[a-z]*$'))) OR regexp_matches(name, '^[kw][a-z]{{1,3}}tv[0-9]*$') OR ends_with(name, 'sun') THEN 'news'")
    w += [f"WHEN NOT contains(replace(name, 'tourism', ''), 'tour') AND (starts_with(name, '{h}') OR ends_with(name, '{h}') OR list_contains(words, '{h}')) THEN 'directory'" for h in DIRECTORY_HINTS]
    w += [f"WHEN ends_with(domain, '{t}') OR contains(domain, '{t}.') THEN 'directory'" for t in (".org", ".gov")]
    return "CASE " + " ".join(w) + " ELSE 'business' END"


_EXTRA = [f"{e}.com" if "." not in e else e for _, own in CLASSES for e in own] + ["a.edu", "b.edu.au", "daily-news.com", "capetimes.co.uk", "fox10.com", "wbtv.com", "citysun.com", "visitx.com", "downtowntours.com", "tourism-x.com", "x.org", "y.gov.uk", "booking.rivaltours.com", "my-yelp.com"]
_NAMED = f"(SELECT *, string_split(name, '-') AS words FROM (SELECT *, {_NAME} AS name FROM (SELECT *, string_split(domain, '.') AS p FROM {{0}})))"

SQL = {
    "result_page_rows": r"""WITH o AS (SELECT organic_id, seq, regexp_replace(url, '^[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g') AS url, coalesce(title, '') AS title, coalesce(lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM serp_organic WHERE regexp_matches(url, '^https?://'))
SELECT organic_id, 'organic' AS kind, 'blocks' AS parse_mode, 1 AS position, url, CASE WHEN trim(title) = '' THEN '' ELSE array_to_string(list_filter(regexp_split_to_array(title, '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> ''), ' ') END AS title, seq AS slot
FROM o WHERE host <> '' AND NOT regexp_matches(host, '(^|\.)(brave\.com|brave\.app|w3\.org|hackerone\.com)$') AND NOT regexp_matches(lower(path), '\.(png|jpe?g|gif|webp|avif|svg|ico|css|js|mjs|woff2?|ttf|otf|eot|mp4|webm|json|xml|webmanifest|map)$')""",
    "organic_top_rows": f"WITH {_TOP} SELECT serp_id, CAST(rn AS INTEGER) AS rn, organic_id, url, position FROM top",
    "domain_tally": f"WITH {_TALLY} SELECT * FROM tally",
    "domain_positions": f"WITH {_TOP} SELECT dom AS domain, lower(query) AS query_key, count(*) AS n_results, min(position) AS best_pos, count(DISTINCT position) AS n_positions FROM top WHERE dom <> '' GROUP BY ALL",
    "classified_domains": f"""WITH d AS (SELECT {_ND.format('domain')} AS domain FROM serp_organic UNION SELECT unnest([{','.join(f"'{e}'" for e in _EXTRA)}])), n AS (SELECT * FROM d WHERE domain <> '')
SELECT domain, {_class_sql(('hollow-aquarium.example',), {'copper-theatre.example': 'marketplace'})} AS category FROM {_NAMED.format('n')}""",
    "shortlist": f"WITH {_TALLY} SELECT domain, score, n_queries, best_pos FROM {_NAMED.format('tally')} WHERE {_class_sql()} = 'business' ORDER BY score DESC, n_queries DESC, best_pos NULLS LAST, domain LIMIT {SHORTLIST}",
    "own_domains": f"""WITH {_TALLY}, o AS (SELECT unnest([{','.join(f"'{x}'" for x in OWN)}]) AS own)
SELECT own, CAST(coalesce(sum(appearances), 0) AS BIGINT) AS appearances, coalesce(CAST(sum(CAST(score AS DECIMAL(20,12))) AS DOUBLE), 0.0) AS score FROM o LEFT JOIN tally ON domain = own OR ends_with(domain, '.' || own) GROUP BY own""",
    "query_list": "SELECT lower(query) AS query_key, first(query ORDER BY serp_id) AS query, count(*) AS n_records FROM serp_records WHERE query IS NOT NULL GROUP BY 1",
    "not_captured": "SELECT DISTINCT lower(query) AS query_key FROM serp_records WHERE query IS NOT NULL AND lower(query) NOT IN (SELECT lower(query) FROM serp_organic WHERE url IS NOT NULL AND query IS NOT NULL)",
    "local_pack_tally": """SELECT lower(trim(title)) AS place, count(DISTINCT lower(query)) AS n_queries, count(*) AS appearances, min(CASE WHEN position > 0 THEN position END) AS best_pos,
last(rating ORDER BY serp_id, seq, rating) FILTER (rating IS NOT NULL) AS rating, max(reviews) AS reviews, first(domain ORDER BY serp_id, seq, domain) FILTER (domain <> '') AS domain, min(serp_id) AS first_serp
FROM serp_local WHERE title IS NOT NULL AND trim(title) <> '' GROUP BY 1""",
    "engine_share": """WITH p AS (SELECT serp_id, count(*) AS n, count(*) FILTER (position BETWEEN 1 AND 3) AS top3 FROM serp_organic GROUP BY 1)
SELECT engine_key, parse_mode, count(*) AS n_records, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_results, CAST(sum(coalesce(top3, 0)) AS BIGINT) AS n_top3 FROM serp_records LEFT JOIN p USING (serp_id) GROUP BY ALL""",
    "stop_rule": """WITH e AS (SELECT *, event_type = 'error' AS failed, coalesce(lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS before FROM events),
s AS (SELECT user_id, min({'ts': ts, 'id': event_id}) FILTER (failed AND before) AS stop FROM e GROUP BY 1)
SELECT user_id, count(*) AS n_kept FROM e JOIN s USING (user_id) WHERE stop IS NULL OR {'ts': ts, 'id': event_id} < stop GROUP BY 1""",
}
SQL["ordered_places"] = f"SELECT place, n_queries, best_pos FROM ({SQL['local_pack_tally']})"
