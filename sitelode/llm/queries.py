"""The queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.llm import capping, copies, frequency, packing, personal, residue, tokens
from sitelode.session import cut, table


def _terms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, int]]:
    organic, pages = table(spark, sf_dir, "serp_organic"), table(spark, sf_dir, "pages")
    domains = organic.select(F.lit("organic.domain").alias("field"), F.array(frequency.domain_key("domain")).alias("terms"))
    types = pages.select(F.lit("pages.schema_types").alias("field"), F.col("schema_types").alias("terms"))
    return domains.unionByName(types), {"organic.domain": organic.count(), "pages.schema_types": pages.count()}


def _p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, totals = _terms(spark, sf_dir)
    return frequency.marked(frequency.ngram_counts(rows, "terms", group="field"), totals)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values too rare or too common to tell sites apart."""
    return _p1(spark, sf_dir).where("mark is not null").select(F.col("group_name").alias("field"), F.col("t1").alias("term"), "mark")


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value with its occurrences, rows and mark."""
    return _p1(spark, sf_dir).select(F.col("group_name").alias("field"), F.col("t1").alias("term"), "occurrences", F.col("records").alias("n_rows"), "mark")


def p1_type_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of up to three schema types with their occurrences and pages."""
    return frequency.ngram_counts(table(spark, sf_dir, "pages"), "schema_types", max_n=3).select("n", "t1", "t2", "t3", "occurrences", F.col("records").alias("n_rows"))


def _results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    organic = table(spark, sf_dir, "serp_organic")
    rows = organic.where("url is not null and domain is not null and domain <> ''")
    text = F.concat_ws("\x01", copies.canonical_text(F.col("domain")), copies.canonical_url(F.col("url")))
    return copies.hashed(rows, "organic_id", [F.col("serp_id")], text), organic.count()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each result that comes again in its record, with the one that is kept."""
    return copies.copies_of(*_results(spark, sf_dir))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each distinct result: its least id and its number of copies."""
    return copies.copy_groups(_results(spark, sf_dir)[0]).select(F.col("kept").alias("kept_id"), "n_copies")


def p3_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of results that 128 bits alone would have made one: how many, and how many groups and rows there are."""
    by_hash = copies.copy_groups(_results(spark, sf_dir)[0]).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.sum("n_copies").alias("rows"))
    return by_hash.agg(F.sum("n").alias("n_groups"), F.sum("rows").alias("n_rows"), F.count_if(F.col("n") > 1).alias("n_collisions"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results left out so that no domain has more than a hundredth of all rows."""
    position = F.when(F.col("position") >= 1, F.col("position"))
    out = capping.over_cap(table(spark, sf_dir, "serp_organic"), frequency.domain_key("domain"), position, "organic_id", max_share=0.01)
    return out.select(F.col("id").alias("organic_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose title or description was never filled in or reports a failure."""
    pages = residue.with_residue(table(spark, sf_dir, "pages").select("page_id", "title", "description"), ["title", "description"])
    return pages.where("residue_title is not null or residue_description is not null").select("page_id")


def p5_clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages without such texts."""
    return residue.without_residue(table(spark, sf_dir, "pages"), ["title", "description"])


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    return tokens.encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text with the byte where each begins."""
    return tokens.encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", offsets=True)


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as its ids decode; that is the text itself, and the empty one for null."""
    return tokens.decode_corpus(p7_ids(spark, sf_dir), "doc_id")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = cut(tokens.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"), "token-counts")
    # packing_profiles is a fixed table of three rows.
    profiles = {r["profile_id"]: r["capacity_tokens"] for r in table(spark, sf_dir, "packing_profiles").collect()}
    return packing.pack(sizes, "doc_id", "n_tokens", profiles)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's container for each capacity, in pieces where it alone exceeds it."""
    return _packed(spark, sf_dir).withColumnRenamed("item_id", "doc_id")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and used space for each capacity."""
    return packing.fill_report(_packed(spark, sf_dir)).withColumn("used_share", F.round("used_share", 6))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of personal information in the texts."""
    return personal.find(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "name_lexicon"))


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with each piece replaced by a placeholder of its kind."""
    return personal.redact(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "name_lexicon"))


QUERIES = {f.__name__: f for f in (p1_found, p1_terms, p1_type_ngrams, p3_found, p3_groups, p3_collisions, p4_found, p5_found, p5_clean_pages, p7_ids, p7_offsets, p7_decoded, p8_containers, p8_fill, p9_found, p9_redacted)}

SQL = {
    "p1_terms": r"""
WITH d AS (SELECT nullif(regexp_replace(lower(domain), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'), '') AS term, organic_id AS id FROM serp_organic),
s AS (SELECT unnest(schema_types) AS term, page_id AS id FROM pages),
c AS (SELECT 'organic.domain' AS field, term, count(*) AS occurrences, count(DISTINCT id) AS n_rows, (SELECT count(*) FROM serp_organic) AS total FROM d WHERE term IS NOT NULL GROUP BY term
UNION ALL SELECT 'pages.schema_types', term, count(*), count(DISTINCT id), (SELECT count(*) FROM pages) FROM s WHERE term IS NOT NULL GROUP BY term)
SELECT field, term, occurrences, n_rows, CASE WHEN n_rows <= 2 THEN 'rare' WHEN n_rows > total * 0.05 THEN 'common' END AS mark FROM c""",
    "p4_found": r"""
WITH d AS (SELECT organic_id, position, nullif(regexp_replace(lower(domain), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'), '') AS k FROM serp_organic),
r AS (SELECT organic_id, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN position >= 1 THEN position END NULLS LAST, organic_id) AS rn FROM d WHERE k IS NOT NULL)
SELECT organic_id FROM r WHERE rn > (SELECT count(*) // 100 FROM serp_organic)""",
}
SQL["p1_found"] = f"SELECT field, term, mark FROM ({SQL['p1_terms']}) WHERE mark IS NOT NULL"
_CANON = r"""
WITH r AS (SELECT organic_id, serp_id, regexp_replace(lower(domain), '[^\p{L}\p{N}]+', '', 'g') AS d, instr(url, '?') AS q, url FROM serp_organic WHERE url IS NOT NULL AND domain IS NOT NULL AND domain <> ''),
k AS (SELECT organic_id, serp_id, d, regexp_replace(lower(CASE WHEN q > 0 THEN url[:q - 1] ELSE url END), '[^\p{L}\p{N}]+', '', 'g') AS h,
 CASE WHEN q > 0 THEN array_to_string(list_sort(list_filter(string_split(regexp_replace(lower(url[q + 1:]), '[^\p{L}\p{N}&]+', '', 'g'), '&'), lambda x: x <> '')), '&') ELSE '' END AS p FROM r),
g AS (SELECT organic_id, min(organic_id) OVER w AS kept_id, count(*) OVER w AS n FROM k WINDOW w AS (PARTITION BY serp_id, d, h, p))"""
SQL["p3_found"] = _CANON + " SELECT kept_id, organic_id AS copy_id FROM g WHERE organic_id <> kept_id"
SQL["p7_decoded"] = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
SQL["p3_collisions"] = _CANON + " SELECT count(*) FILTER (organic_id = kept_id) AS n_groups, count(*) AS n_rows, 0::BIGINT AS n_collisions FROM g"
SQL["p3_groups"] = _CANON + " SELECT kept_id, count(*) AS n_copies FROM g GROUP BY kept_id"
SQL["p1_type_ngrams"] = r"""
WITH s AS (SELECT page_id, schema_types AS a, unnest(range(1, len(schema_types) + 1)) AS i FROM pages),
g AS (SELECT page_id, a[i:i + 1 - 1] AS g FROM s UNION ALL SELECT page_id, a[i:i + 1] FROM s WHERE i + 1 <= len(a) UNION ALL SELECT page_id, a[i:i + 2] FROM s WHERE i + 2 <= len(a)),
v AS (SELECT page_id, g FROM g WHERE len(list_filter(g, lambda x: x IS NULL)) = 0)
SELECT CAST(len(g) AS TINYINT) AS n, g[1] AS t1, g[2] AS t2, g[3] AS t3, count(*) AS occurrences, count(DISTINCT page_id) AS n_rows FROM v GROUP BY g"""
