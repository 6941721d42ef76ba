"""Findings to scores: keep-first dedup, diminishing deductions, category and overall scores, priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the categories in the overall score, fixed values.
CATEGORY_WEIGHTS = {"crawlability": 0.20, "on page": 0.18, "performance": 0.15, "ai search": 0.10, "schema": 0.10, "trust": 0.10, "mobile": 0.09, "social": 0.08}
#: What a finding takes off, fixed values.
SEVERITY_WEIGHTS = {"CRITICAL": 40, "HIGH": 20, "MEDIUM": 10, "LOW": 4, "INFO": 0}
#: What the first, second, ... deduction of a category counts; the last value holds for all further ones. Fixed values.
DIMINISHING = (1.0, 1.0, 0.75, 0.75, 0.5)
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")


def severity_rank(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), c).cast("int")


def weight(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = F.when(F.lit(False), 0)
    for s, w in SEVERITY_WEIGHTS.items():
        out = out.when(c == s, w)
    return out.otherwise(0)


def first_findings(findings: DataFrame) -> DataFrame:
    """One finding for each (site, category, title): the first one by ``ord``. Combined before the shuffle, so a large site isn't one task."""
    rest = [c for c in findings.columns if c not in ("site", "category", "title")]
    first = findings.groupBy("site", "category", "title").agg(F.min_by(F.struct(*rest), "ord").alias("_f"))
    return first.select("site", "category", "title", "_f.*")


def category_scores(findings: DataFrame) -> DataFrame:
    """site, category, score, n_findings for each category with findings. Distinct titles of a site are bounded by the catalogue."""
    ranked = first_findings(findings).withColumn("w", weight("severity")).withColumn("rn", F.row_number().over(Window.partitionBy("site", "category").orderBy(F.desc("w"), "title")))
    factor = F.element_at(F.array(*map(F.lit, DIMINISHING)), F.least("rn", F.lit(len(DIMINISHING))))
    taken = ranked.groupBy("site", "category").agg(F.sum(F.col("w") * factor).alias("taken"), F.count("*").alias("n_findings"))
    return taken.select("site", "category", F.greatest(F.lit(0), F.rint(F.lit(100) - F.col("taken")).cast("int")).alias("score"), "n_findings")


def overall_scores(scores: DataFrame) -> DataFrame:
    """site, overall: the weighted sum; a category without findings counts 100."""
    w = F.create_map(*(x for k, v in CATEGORY_WEIGHTS.items() for x in (F.lit(k), F.lit(v).cast("decimal(4,2)"))))
    known = scores.where(F.col("category").isin(*CATEGORY_WEIGHTS))
    lost = known.groupBy("site").agg(F.sum((F.lit(100) - F.col("score")) * w[F.col("category")]).alias("lost"))
    return lost.select("site", F.rint(F.lit(100) - F.col("lost").cast("double")).cast("int").alias("overall"))


def with_speed_cap(scores: DataFrame, speed: DataFrame) -> DataFrame:
    """The performance score is no higher than a measured one; ``speed`` has site and measured."""
    joined = scores.join(speed, "site", "left")
    return joined.withColumn("score", F.when(F.col("category") == "performance", F.least("score", "measured")).otherwise(F.col("score"))).drop("measured")


def top_priorities(findings: DataFrame, limit: int = 8) -> DataFrame:
    """The findings of a site to look at first: distinct titles by severity, effort and impact, none of INFO (a top-k report)."""
    real = first_findings(findings).where("severity <> 'INFO'")
    one = real.groupBy("site", "title").agg(F.min(F.struct(severity_rank("severity").alias("s"), F.col("effort").alias("e"), (-F.col("impact")).alias("i"), F.col("ord"), F.col("category"), F.col("severity"))).alias("x"))
    rank = F.row_number().over(Window.partitionBy("site").orderBy("x.s", "x.e", "x.i", "x.ord", "title"))
    return one.withColumn("place", rank).where(F.col("place") <= limit).select("site", "place", "title", "x.category", "x.severity")


def sweep_summary(findings: DataFrame, swept: DataFrame, deep: DataFrame | None = None) -> DataFrame:
    """One row for each kind of finding on swept pages: count, templates, first example, severity softened if it is rare.

    ``findings`` has site, category, title, severity, url, template, ord; ``swept`` has site and n_pages;
    kinds that ``deep`` (site, category, title) has are left out.
    """
    own = findings.where("severity <> 'INFO'")
    if deep is not None:
        own = own.join(deep.select("site", "category", "title").distinct(), ["site", "category", "title"], "left_anti")
    kinds = own.groupBy("site", "category", "title").agg(
        F.count("*").alias("n"), F.count_distinct("template").alias("n_templates"), F.min_by("url", "ord").alias("example"), F.min_by("severity", "ord").alias("first_severity")
    )
    rare = F.col("n") < F.greatest(F.lit(2.0), F.col("n_pages") * 0.1)
    soft = F.when(rare & (F.col("first_severity") == "HIGH"), "MEDIUM").when(rare & (F.col("first_severity") == "MEDIUM"), "LOW").otherwise(F.col("first_severity"))
    return kinds.join(swept, "site").withColumn("severity", soft).drop("n_pages")
