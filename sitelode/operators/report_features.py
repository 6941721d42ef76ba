"""Audit reports side by side: what each site has or lacks, its findings from all parts of a report, and whether scores compare.

Reports are VARIANT values (``try_parse_json`` of the payload). Everything is built-in expressions on them: one
projection gives all features of a report as rows, without a shuffle. A part that an older report lacks is unknown,
which is null in ``present`` and 'n/a' in ``value``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelode.functions import text
from sitelode.operators import scoring

#: Marks of free-text health values, fixed values: what can't be told, and what is absent.
UNKNOWN = ("not checked", "not tested", "could not")
ABSENT = ("✗", "none", "not found", "not present")
#: Types of organizations whose names don't end in Business or Organization, fixed values.
ORGANIZATION_TYPES = (
    "Organization", "Corporation", "NGO", "LocalBusiness", "TravelAgency", "TouristInformationCenter", "Restaurant", "FoodEstablishment", "Store", "Hotel", "ProfessionalService", "LegalService", "FinancialService",
    "RealEstateAgent", "Dentist", "Physician", "ExerciseGym",
)
#: Verdicts on agents that a site turns away begin with one of these, fixed values.
TURNED_AWAY = ("refused", "challenged", "pay-per-crawl")
#: Reports whose numbers of audited pages differ by more than this factor don't compare.
PAGE_RATIO = 3.0

_LIST, _TEXTS = "array<variant>", "array<string>"


def get(v: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, kind)


def _kind(v: Column | str, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(get(v, path, "variant")), F.lit("VOID"))


def whole(v: Column | str, path: str) -> Column:
    """A whole number, or a text that is one; a boolean is none."""
    return F.when(_kind(v, path) == "BOOLEAN", F.lit(None).cast("bigint")).otherwise(get(v, path, "bigint"))


def truth(v: Column | str, path: str) -> Column:
    """A boolean; null for anything else."""
    return F.when(_kind(v, path) == "BOOLEAN", get(v, path, "boolean"))


def items(v: Column | str, path: str) -> Column:
    """The objects of a list, empty where there is none."""
    return F.filter(F.coalesce(get(v, path, _LIST), F.array().cast(_LIST)), lambda x: F.schema_of_variant(x).startswith("OBJECT"))


def pages(v: Column | str) -> Column:
    return items(v, "$.pages")


def homepage(v: Column | str) -> Column:
    """The page that is marked as the homepage, else the first one."""
    own = pages(v)
    return F.coalesce(F.get(F.filter(own, lambda p: get(p, "$.source") == "homepage"), F.lit(0)), F.get(own, F.lit(0)))


def health(v: Column | str, label: str) -> Column:
    """The text of a health row."""
    rows = F.coalesce(get(v, "$.health", _LIST), F.array().cast(_LIST))
    return get(F.get(F.filter(rows, lambda r: (get(r, "$[0]") == label) & get(r, "$[1]", "variant").isNotNull()), F.lit(0)), "$[1]")


def _any(t: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | t.contains(m)
    return out


def told(t: Column) -> Column:
    """The text, or null if it says that nothing is known."""
    return F.when(t.isNotNull() & ~_any(F.lower(t), UNKNOWN), t)


def health_flag(t: Column) -> Column:
    """Whether a free-text health value says that something is there; null if it can't be told."""
    return F.when(told(t).isNotNull(), ~_any(F.lower(t), ABSENT))


def tick(t: Column, label: str) -> Column:
    """Whether a label has a tick or a cross behind it in a health value; null for neither."""
    mark = F.regexp_extract(F.coalesce(told(t), F.lit("")), rf"\Q{label}\E\s*([✓✗])", 1)
    return F.when(mark == "✓", True).when(mark == "✗", False)


def sitemap_found(v: Column | str) -> Column:
    return F.coalesce(truth(v, "$.sitemap_found"), whole(v, "$.sitemap_url_count") > 0)


def pages_audited(v: Column | str) -> Column:
    return whole(v, "$.page_count") + F.coalesce(whole(v, "$.sweep_count"), F.lit(0))


def _types(page: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(get(page, "$.schema_types", _TEXTS), F.array().cast(_TEXTS)), lambda t: t.isNotNull())))


def _number(n: Column) -> Column:
    return F.coalesce(F.format_number(n, 0), F.lit("n/a"))


def _listed(values: Column) -> Column:
    return F.array_join(values, ", ")


def feature_cells(v: str) -> list[Column]:
    """(feature, value, present) of all features of a report; ``present`` is null for what is only told."""

    def cell(name: str, present: Column | None, detail: Column | None = None, value: Column | None = None) -> Column:
        flag = F.lit(None).cast("boolean") if present is None else present
        if value is None:
            value = F.when(flag.isNull(), F.lit("n/a")).otherwise(F.concat(F.when(flag, "yes").otherwise("no"), F.when(detail != "", F.concat(F.lit(" ("), detail, F.lit(")"))).otherwise("") if detail is not None else F.lit("")))
        return F.struct(F.lit(name).alias("feature"), F.coalesce(value, F.lit("n/a")).alias("value"), flag.alias("present"))

    home, own = homepage(v), pages(v)
    n_pages = F.size(own)
    rendered = F.size(F.filter(own, lambda p: F.coalesce(truth(p, "$.client_rendered"), F.lit(False))))
    types = F.when(home.isNotNull(), _types(home))
    org = F.filter(types, lambda t: t.isin(*ORGANIZATION_TYPES) | t.endswith("Business") | t.endswith("Organization"))
    out = [
        cell("robots_txt", truth(v, "$.robots_found")), cell("sitemap", sitemap_found(v)), cell("sitemap_urls", None, value=_number(whole(v, "$.sitemap_url_count"))),
        cell("jsonld_home", F.when(types.isNotNull(), F.size(types) > 0)), cell("schema_home", None, value=F.when(F.size(types) > 0, _listed(types)).when(types.isNotNull(), "none")),
        cell("org_home", F.when(types.isNotNull(), F.size(org) > 0), _listed(org)),
    ]
    for name, wanted in (("breadcrumb", "BreadcrumbList"), ("faq", "FAQPage")):
        n = F.size(F.filter(own, lambda p: F.array_contains(_types(p), wanted)))  # noqa: B023
        out.append(cell(name, F.when(n_pages > 0, n > 0), F.concat(n, F.lit(" of "), n_pages, F.lit(" pages"))))
    for name, label in (("analytics", "Analytics"), ("llms", "llms.txt")):
        out.append(cell(name, health_flag(health(v, label))))
    trust, entity = health(v, "Contact & trust pages"), health(v, "Entity transparency")
    out.append(cell("contact", F.when(told(trust).isNotNull(), ~F.lower(F.split(trust, "·")[0]).contains("no contact"))))
    out += [cell(k, tick(trust, k)) for k in ("about", "privacy", "terms")] + [cell("postal", tick(entity, "postal address")), cell("legal", tick(entity, "legal entity named"))]
    # A report without the row says that the header isn't sent only if its homepage answered.
    hsts = health(v, "HSTS")
    answered = (F.size(F.coalesce(get(v, "$.health", _LIST), F.array().cast(_LIST))) > 0) & F.coalesce(whole(home, "$.status") == 200, F.lit(False))
    out.append(cell("hsts", F.when(hsts.isNotNull(), health_flag(hsts)).when(answered, False)))
    out.append(cell("tls_days", None, value=F.nullif(F.regexp_extract(F.coalesce(health(v, "TLS certificate"), F.lit("")), r"(-?\d+)\s+days?\s+left", 1), F.lit(""))))
    # Agents that were served, turned away, or not answered at all.
    matrix = items(v, "$.ai_matrix")
    verdict = lambda m: F.coalesce(get(m, "$.verdict"), F.lit(""))
    away = lambda m: F.exists(F.array(*map(F.lit, TURNED_AWAY)), lambda t: verdict(m).startswith(t))
    names = lambda ms: F.array_join(F.transform(ms, lambda m: F.coalesce(get(m, "$.agent"), F.lit("None"))), ", ")
    refused, silent = F.filter(matrix, away), F.filter(matrix, lambda m: ~away(m) & ~verdict(m).startswith("ok"))
    tail = lambda ms, before, after: F.when(F.size(ms) > 0, F.concat(before, F.lit(" ("), names(ms), F.lit(")"))).otherwise(after)
    served = F.concat(
        F.size(matrix) - F.size(refused) - F.size(silent), F.lit(" ok, "), tail(refused, F.concat(F.size(refused), F.lit(" refused")), F.concat(F.size(refused), F.lit(" refused"))),
        tail(silent, F.concat(F.lit(", "), F.size(silent), F.lit(" not answered")), F.lit("")),
    )
    out.append(cell("ai_edge", F.when(F.size(matrix) == 0, None).when(F.size(refused) > 0, False).when(F.size(silent) > 0, None).otherwise(True), value=F.when(F.size(matrix) == 0, "not tested").otherwise(served)))
    # The homepage.
    title, description = get(home, "$.title"), get(home, "$.description")
    has = lambda k: _kind(home, f"$.{k}") != "VOID"
    h1 = F.filter(F.coalesce(get(home, "$.h1", _TEXTS), F.array().cast(_TEXTS)), lambda h: F.trim(h) != "")
    chars = lambda t: F.concat(F.length(F.coalesce(t, F.lit(""))), F.lit(" chars"))
    more = F.when(F.size(h1) > 1, F.concat(F.lit(" (+"), F.size(h1) - 1, F.lit(" more)"))).otherwise("")
    out += [
        cell("home_words", None, value=_number(whole(home, "$.word_count"))), cell("home_title", F.when(has("title"), F.coalesce(title, F.lit("")) != ""), value=F.when(has("title"), F.coalesce(F.nullif(title, F.lit("")), F.lit("none")))),
        cell("home_title_len", None, value=F.when(has("title"), chars(title))), cell("home_desc_len", F.when(has("description"), F.coalesce(description, F.lit("")) != ""), value=F.when(has("description"), F.when(description != "", chars(description)).otherwise("none"))),
        cell("home_h1", F.when(has("h1"), F.size(h1) > 0), value=F.when(has("h1"), F.when(F.size(h1) > 0, F.concat(F.get(h1, F.lit(0)), more)).otherwise("none"))),
        cell("client_rendered", None, value=F.when(n_pages > 0, F.concat(rendered, F.lit(" of "), n_pages))),
    ]
    # The share image, profiles and key phrases.
    metrics, social = F.coalesce(get(v, "$.social.metrics", _LIST), F.array().cast(_LIST)), items(v, "$.social.findings")
    seen = (F.size(metrics) > 0) | (F.size(F.coalesce(get(v, "$.social.findings", _LIST), F.array().cast(_LIST))) > 0)
    size = get(F.get(F.filter(metrics, lambda m: get(m, "$[0]") == "Image dimensions"), F.lit(0)), "$[1]")
    image = size.isNotNull() | ~F.exists(social, lambda f: F.coalesce(get(f, "$.title") == "No Open Graph image", F.lit(False)))
    out.append(cell("og_image", F.when(seen, image), F.coalesce(size, F.when(image, "declared, not measured"), F.lit(""))))
    print_ = _kind(v, "$.footprint").startswith("OBJECT")
    profiles = F.filter(items(v, "$.footprint.social"), lambda s: F.coalesce(get(s, "$.url"), F.lit("")) != "")
    n_urls = F.size(F.array_distinct(F.transform(profiles, lambda s: get(s, "$.url"))))
    platforms = F.array_sort(F.array_distinct(F.transform(profiles, lambda s: F.coalesce(F.nullif(get(s, "$.platform"), F.lit("")), F.lit("other")))))
    out.append(cell("social", F.when(print_, n_urls > 0), value=F.when(print_, F.when(n_urls > 0, F.concat(n_urls, F.lit(" ("), _listed(platforms), F.lit(")"))).otherwise("none"))))
    out.append(cell("sameas", F.when(print_, truth(v, "$.footprint.sameas_present"))))
    linked = lambda k: F.size(F.array_distinct(F.coalesce(get(v, f"$.footprint.google.{k}", _TEXTS), F.array().cast(_TEXTS))))
    google = F.when(print_ & _kind(v, "$.footprint.google").startswith("OBJECT"), linked("maps_links") + linked("gbp_links") > 0)
    out.append(cell("google", google, F.when(google, F.concat(linked("maps_links"), F.lit(" Maps, "), linked("gbp_links"), F.lit(" Business Profile"))).otherwise("")))
    out += [cell("kw_primary", None, value=F.nullif(get(v, "$.keywords.primary"), F.lit(""))), cell("kw_top5", None, value=F.nullif(_listed(F.slice(top_terms(v), 1, 5)), F.lit("")))]
    return out


def top_terms(v: Column | str) -> Column:
    """The key phrases of a report in order, without empty ones."""
    return F.filter(F.transform(items(v, "$.keywords.terms"), lambda t: get(t, "$.term")), lambda t: t != "")


def site_features(reports: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """keys, feature, value, present: a row for each feature of each report (``v`` is the report as VARIANT)."""
    return reports.select(*keys, F.explode(F.array(*feature_cells(v))).alias("x")).select(*keys, "x.*")


def report_findings(reports: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """keys, part, category, title, severity, count: the findings of all six parts of a report.

    Site-wide, swept, social, footprint and page findings, and those of the speed test if it ran; swept ones count their pages.
    """
    speed = F.when(get(v, "$.psi.status") == "ok", items(v, "$.psi.findings")).otherwise(F.array().cast(_LIST))
    of_pages = F.flatten(F.transform(pages(v), lambda p: items(p, "$.findings")))
    parts = (("site-wide", items(v, "$.site_findings")), ("sweep", items(v, "$.sweep_summary")), ("social", items(v, "$.social.findings")), ("footprint", items(v, "$.footprint.findings")), ("pagespeed", speed), ("page", of_pages))
    tagged = F.concat(*(F.transform(found, lambda f: F.struct(F.lit(part).alias("part"), f.alias("f"))) for part, found in parts))  # noqa: B023
    each = reports.select(*keys, F.explode(tagged).alias("x"))
    f = F.col("x.f")
    n = F.when(F.col("x.part") == "sweep", F.coalesce(F.nullif(whole(f, "$.count"), F.lit(0)), F.lit(1))).otherwise(1)
    rows = each.select(*keys, F.col("x.part").alias("part"), F.coalesce(get(f, "$.category"), F.lit("")).alias("category"), get(f, "$.title").alias("title"), F.upper(F.coalesce(F.nullif(get(f, "$.severity"), F.lit("")), F.lit("INFO"))).alias("severity"), n.cast("bigint").alias("count"))
    return rows.where("title <> ''")


def finding_kinds(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Kinds of findings with masked numbers: worst severity, and how often in each part (keys, category, key, severity, part, n)."""
    own = findings.withColumn("key", text.finding_key("title"))
    rank = F.coalesce(F.nullif(scoring.severity_rank("severity"), F.lit(0)), F.lit(9))
    worst = own.groupBy(*keys, "category", "key").agg(F.min(F.struct(rank.alias("r"), "severity"))["severity"].alias("severity"))
    return own.groupBy(*keys, "category", "key", "part").agg(F.sum("count").alias("n")).join(worst, [*keys, "category", "key"])


def score_caveats(reports: DataFrame, group: list[str], client: Column, v: str = "v") -> DataFrame:
    """Whether each rival's score compares with that of its group's client: group, site, ratio, over_limit, caveat.

    ``reports`` has group, site and the report; ``client`` says which row of a group is the client's (one). A caveat
    applies if page counts differ by more than the limit or either site has no sitemap, and is null if that isn't known.
    """
    own = reports.select(*group, "site", client.alias("is_client"), pages_audited(v).alias("b"), sitemap_found(v).alias("s"))
    clients = own.where("is_client").select(*group, F.col("b").alias("a"), F.col("s").alias("cs"))
    met = own.where("not is_client").join(clients, group)
    low, high = F.least("a", "b"), F.greatest("a", "b")
    known = F.col("a").isNotNull() & F.col("b").isNotNull()
    over = F.when(known, F.when(low > 0, high / low > PAGE_RATIO).otherwise(high > 0)).otherwise(False)
    ratio = F.when(known & (low > 0), F.round(high / low, 1))
    lacks = F.coalesce(~F.col("s"), F.lit(False)) | F.coalesce(~F.col("cs"), F.lit(False))
    unknown = ~known | F.col("s").isNull() | F.col("cs").isNull()
    return met.select(*group, "site", ratio.alias("ratio"), over.alias("over_limit"), F.when(over | lacks, True).when(unknown, None).otherwise(False).alias("caveat"))
