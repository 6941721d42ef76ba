"""Several audited sites side by side: category gaps, finding differences, features, caveats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelode.functions import text
from sitelode.operators import scoring

#: Pages audited by two sites may differ by this factor before a comparison carries a caveat.
PAGE_RATIO = 3.0


def category_gaps(scores: DataFrame, group: list[str]) -> DataFrame:
    """Each site's score in a category against the best other site of its group, and its rank (scores: group, site, category, score).

    The best two scores of a category stand for all rivals, so a large group needs no window.
    """
    top = scores.groupBy(*group, "category").agg(F.max(F.struct("score", "site")).alias("one"))
    others = scores.join(top, [*group, "category"]).where(F.col("site") != F.col("one.site"))
    second = others.groupBy(*group, "category").agg(F.max("score").alias("two"))
    ladder = scores.groupBy(*group, "category", "score").agg(F.count("*").alias("c"))
    above = F.sum("c").over(Window.partitionBy(*group, "category").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    ranks = ladder.withColumn("rank", F.coalesce(above, F.lit(0)) + 1).drop("c")
    joined = scores.join(top, [*group, "category"]).join(second, [*group, "category"], "left").join(ranks, [*group, "category", "score"])
    rival = F.when(F.col("site") == F.col("one.site"), F.col("two")).otherwise(F.col("one.score"))
    return joined.select(*group, "site", "category", "score", rival.alias("best_rival"), (F.col("score") - rival).alias("gap"), "rank")


def collect_findings(findings: DataFrame) -> DataFrame:
    """Kinds of findings of a site with masked numbers: worst severity and count (site, category, title, severity, count)."""
    own = findings.withColumn("key", text.finding_key("title"))
    return own.groupBy("site", "category", "key").agg(F.min(F.struct(scoring.severity_rank("severity").alias("r"), "severity")).alias("w"), F.sum(F.coalesce("count", F.lit(1))).alias("n")).select("site", "category", "key", F.col("w.severity").alias("severity"), "n")


def unique_findings(findings: DataFrame, client: str) -> tuple[DataFrame, DataFrame]:
    """(kinds that only the client has, kinds that a rival has and the client hasn't)."""
    kinds = collect_findings(findings)
    mine, theirs = kinds.where(F.col("site") == client), kinds.where(F.col("site") != client)
    return mine.join(theirs.select("category", "key").distinct(), ["category", "key"], "left_anti"), theirs.join(mine.select("category", "key").distinct(), ["category", "key"], "left_anti")


def advantages(features: DataFrame, client: str) -> DataFrame:
    """Features that a rival has and the client lacks (site, feature, present; null is unknown and tells nothing)."""
    lacks = features.where((F.col("site") == client) & ~F.col("present")).select("feature")
    return features.where((F.col("site") != client) & F.col("present")).join(lacks, "feature", "left_semi").select("feature", "site")


def score_caveat(sites: DataFrame, client: str) -> DataFrame:
    """Whether a rival's score compares with the client's (site, pages, sitemap_found): yes, no, or null if unknown."""
    own = F.broadcast(sites.where(F.col("site") == client).select(F.col("pages").alias("p"), F.col("sitemap_found").alias("s")).limit(1))
    rivals = sites.where(F.col("site") != client).withColumn("_k", F.lit(1)).join(own.withColumn("_k", F.lit(1)), "_k")
    ratio = F.greatest("pages", "p") / F.least("pages", "p")
    differs = F.when((F.col("pages") <= 0) | (F.col("p") <= 0), None).otherwise(ratio > PAGE_RATIO) | (F.col("s") != F.col("sitemap_found"))
    return rivals.select("site", differs.alias("caveat"))


def keyword_overlap(terms: DataFrame, client: str) -> DataFrame:
    """Terms of rivals that the client shares or misses (site, place, term)."""
    mine = terms.where(F.col("site") == client).select("term").distinct().withColumn("shared", F.lit(True))
    return terms.where(F.col("site") != client).join(mine, "term", "left").select("site", "place", "term", F.coalesce("shared", F.lit(False)).alias("shared"))
