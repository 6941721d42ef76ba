"""Plans over texts: key phrases, prominence, shingles, repeated sentences, title phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelode.functions import text, urls
from sitelode.operators import near
from sitelode.session import table

#: Weight of a zone, and how often it counts a phrase in one text, fixed values.
ZONES = {"title": (5, 2), "h1": (4, 2), "heading": (3, 3), "meta": (3, 2), "url": (2, 2), "schema": (2, 2), "body": (1, 6)}
#: The audit's rule on boilerplate takes six words, near-duplicates five.
SHINGLE_WORDS, NEAR_WORDS = 6, 5
NEAR = 0.8


def keyphrase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each key phrase occurs, and in how many texts."""
    each = table(spark, sf_dir, "documents").where("text is not null").select(F.explode(text.counted(text.keyphrases("text"))).alias("x"))
    return each.groupBy("x.value").agg(F.sum("x.n").alias("occurrences"), F.count("*").alias("n_texts")).withColumnRenamed("value", "phrase")


def prominence(zones: DataFrame, top_n: int = 12) -> DataFrame:
    """The ``top_n`` phrases of a site by weighted prominence; a phrase whose words are all in a better one is dropped (a top-k report).

    ``zones`` has site, zone and text, one row for each text. Phrases have at most three words, and of these at most 33
    (of 3 + 9 + 27 all but the 6 that use all three) are made of a kept phrase's words and have fewer distinct ones. So
    the best ``34 * top_n`` phrases hold all that can be kept, whatever comes after them.
    """
    terms = zones.where("text is not null and text <> ''").select("site", "zone", F.explode(text.counted(text.keyphrases("text"))).alias("x"))
    counts = terms.select("site", "zone", F.col("x.value").alias("term"), F.col("x.n").alias("c"))
    pairs = lambda i: F.create_map(*(x for z, v in ZONES.items() for x in (F.lit(z), F.lit(v[i]))))[F.col("zone")]
    scored = counts.groupBy("site", "term").agg(
        F.sum(pairs(0) * F.least("c", pairs(1))).alias("score"), F.array_sort(F.collect_set("zone")).alias("zones"), F.sum(F.when(F.col("zone") == "body", F.col("c")).otherwise(0)).alias("body_count")
    )
    rank = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("score"), F.desc(F.length("term")), "term"))
    best = scored.withColumn("rn", rank).where(F.col("rn") <= 34 * top_n)
    listed = best.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("rn", "term", "score", "zones", "body_count"))).alias("l"))
    sub = "size(array_except(split(x.term, ' '), split(k.term, ' '))) = 0 AND size(array_distinct(split(x.term, ' '))) < size(array_distinct(split(k.term, ' ')))"
    kept = F.expr(f"aggregate(l, slice(l, 1, 0), (a, x) -> IF(size(a) >= {top_n} OR exists(a, k -> {sub}), a, concat(a, array(x))))")
    out = listed.withColumn("k", kept).select("site", F.posexplode("k").alias("i", "x"), F.col("k")[0]["score"].alias("top"))
    return out.select("site", (F.col("i") + 1).alias("place"), "x.term", "x.score", text.round_even(F.lit(100.0) * F.col("x.score") / F.col("top")).alias("prominence"), "x.zones", "x.body_count")


def keyword_prominence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key phrases of each site by where its pages have them."""
    p = table(spark, sf_dir, "pages").where("source <> 'sweep' and word_count > 0").withColumn("site", urls.normalize_domain("domain"))
    key = F.col("page_id").cast("string")
    zone = lambda z, c: p.select("site", F.lit(z).alias("zone"), key.alias("instance"), c.alias("text"))
    h1 = p.select("site", F.lit("h1").alias("zone"), "page_id", F.posexplode("h1").alias("i", "text")).select("site", "zone", F.concat_ws("-", "page_id", "i").alias("instance"), "text")
    path = F.translate(urls.path("url"), "/-_", "   ")
    return prominence(zone("title", F.col("title")).union(zone("meta", F.col("description"))).union(zone("url", path)).union(h1))


def _shingled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null and source is not null")
    return d.select(F.col("source").alias("site"), F.coalesce("lang", F.lit("")).alias("lang"), "doc_id", text.shingles("text", SHINGLE_WORDS).alias("s"), text.word_count("text").alias("words")).where("words >= 80")


def _all_shingled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, without the audit rule's length; those without a source or language are groups of their own."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.coalesce("source", F.lit("")).alias("site"), F.coalesce("lang", F.lit("")).alias("lang"), "doc_id", text.any_shingles("text", NEAR_WORDS).alias("s"))


def shingle_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many texts of a group a shingle stands, for those in two or more."""
    each = _shingled(spark, sf_dir).select("site", "lang", F.explode("s").alias("shingle"))
    return each.groupBy("site", "lang", "shingle").agg(F.count("*").alias("n_texts")).where("n_texts > 1")


def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate pairs of distinct texts of a group, by the least id of each."""
    _, reps = near.classes(_all_shingled(spark, sf_dir), ["site", "lang"], "doc_id", "s")
    return near.similar_classes(reps, ["site", "lang"], NEAR).withColumn("similarity", F.round("similarity", 6))


def near_duplicate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class (the least id of equal shingle sets, null and blank texts of a group being one) and the class's links."""
    members, reps = near.classes(_all_shingled(spark, sf_dir), ["site", "lang"], "doc_id", "s")
    pairs = near.similar_classes(reps, ["site", "lang"], NEAR)
    links = pairs.select("site", "lang", F.col("a").alias("class_id")).union(pairs.select("site", "lang", F.col("b").alias("class_id"))).groupBy("site", "lang", "class_id").agg(F.count("*").alias("n_links"))
    return members.join(links, ["site", "lang", "class_id"], "left").select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions of any sites that are nearly the same, by the least page of each distinct one."""
    p = table(spark, sf_dir, "pages").where("description is not null").select(F.lit("").alias("scope"), "page_id", text.any_shingles("description", NEAR_WORDS).alias("s"))
    _, reps = near.classes(p, ["scope"], "page_id", "s")
    return near.similar_classes(reps, ["scope"], NEAR).select("a", "b", F.round("similarity", 6).alias("similarity"))


def boilerplate_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median of shingles that are a text's own: not in max(2, 80 %) of its group's texts."""
    d = _shingled(spark, sf_dir)
    sizes = d.groupBy("site", "lang").agg(F.count("*").alias("n")).where("n >= 3")
    each = d.join(sizes, ["site", "lang"]).select("site", "lang", "n", "doc_id", F.explode_outer("s").alias("h"))
    # Boilerplate is what at least two texts and four in five of the group share; only its few shingles meet the texts again.
    freq = each.groupBy("site", "lang", "n", "h").agg(F.count("*").alias("df"))
    shared = freq.where(F.col("df") >= F.greatest(F.lit(2), F.floor(F.col("n") * 0.8))).select("site", "lang", "h", F.lit(True).alias("boiler"))
    own = each.join(shared, ["site", "lang", "h"], "left").groupBy("site", "lang", "n", "doc_id").agg(F.count_if(F.col("h").isNotNull() & F.col("boiler").isNull()).alias("own"))
    # Counts of each value stand for the sorted list, so a large group is never gathered.
    values = own.groupBy("site", "lang", "n", "own").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("site", "lang").orderBy("own").rowsBetween(Window.unboundedPreceding, 0))
    at = values.withColumn("upto", upto).where(F.col("upto") > F.expr("n div 2"))
    return at.groupBy("site", "lang").agg(F.min("own").alias("median_own"), F.first("n").alias("n_texts"))


def repeated_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of twelve words or more that come again in one text of 150 words or more."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text").where(text.word_count("text") >= 150)
    each = d.select("doc_id", F.explode(text.sentences("text")).alias("s"))
    return each.groupBy("doc_id", F.lower(F.trim("s")).alias("sentence")).agg(F.count("*").alias("n")).where("n > 1").groupBy("doc_id").agg(F.count("*").alias("n_repeated"), F.max("n").alias("most"))


def title_parts(title: str | Column) -> Column:
    """Segments of a title between its separators."""
    c = F.col(title) if isinstance(title, str) else title
    return F.filter(F.transform(F.split(c, r"(?i)\s*[|»:]\s+|\s+[-–—·]\s+|\s+by\s+(?=\S)"), lambda s: F.trim(s)), lambda s: s != "")


def title_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-word phrase that most titles of a site share, its brand aside."""
    p = table(spark, sf_dir, "pages").where("title is not null and trim(title) <> ''").select(urls.normalize_domain("domain").alias("site"), "page_id", title_parts("title").alias("parts"))
    sizes = p.groupBy("site").agg(F.count("*").alias("total")).where("total >= 10")
    ends = p.where(F.size("parts") >= 2).select("site", F.explode(F.array(F.lower(F.col("parts")[0]), F.lower(F.element_at("parts", -1)))).alias("seg"))
    brands = ends.groupBy("site", "seg").agg(F.count("*").alias("c")).join(sizes, "site").where(F.col("c") >= F.greatest(F.lit(3.0), F.col("total") * 0.4)).select("site", "seg")
    segs = p.join(sizes, "site").select("site", "total", "page_id", F.explode("parts").alias("part")).withColumn("seg", F.lower("part"))
    own = segs.join(brands, ["site", "seg"], "left_anti")
    phrases = own.select("site", "total", "page_id", F.explode(text.keyphrases("part")).alias("phrase")).where("phrase like '% %' and phrase not like '% % %'")
    per = phrases.groupBy("site", "total", "phrase").agg(F.count_distinct("page_id").alias("n")).where(F.col("n") < F.col("total") * 0.9)
    best = per.groupBy("site", "total").agg(F.min(F.struct((-F.col("n")).alias("m"), F.length("phrase").alias("len"), "phrase")).alias("b"))
    return best.select("site", "b.phrase", (-F.col("b.m")).alias("n_pages"), "total").where((F.col("n_pages") >= 5) & (F.col("n_pages") >= F.col("total") * 0.15))


QUERIES = {f.__name__: f for f in (keyphrase_counts, keyword_prominence, shingle_frequency, near_duplicate_pairs, near_duplicate_classes, near_descriptions, boilerplate_median, repeated_sentences, title_concentration)}

_STOP = "[" + ",".join("'" + w.replace("'", "''") + "'" for w in text.STOPWORDS) + "]"


def _phrases(expr: str) -> str:
    """SQL for the key phrases of a text."""
    w = f"regexp_extract_all(lower({expr}), '([a-z0-9][a-z0-9''+-]*)', 1)"
    ok = f"len(list_intersect(g, {_STOP})) = 0"
    gram = lambda n: f"list_transform(range(1, len(w) - {n - 2}), lambda i: w[i:i + {n - 1}])"
    return (
        f"(SELECT list_transform(list_concat(list_filter({gram(1)}, lambda g: length(g[1]) > 2 AND NOT regexp_matches(g[1], '^[0-9]+$') AND {ok}),"
        f" list_filter({gram(2)}, lambda g: length(g[1]) > 1 AND length(g[2]) > 1 AND NOT (regexp_matches(g[1], '^[0-9]+$') AND regexp_matches(g[2], '^[0-9]+$')) AND {ok}),"
        f" list_filter({gram(3)}, lambda g: length(g[1]) > 1 AND length(g[2]) > 1 AND length(g[3]) > 1 AND {ok})), lambda g: array_to_string(g, ' ')) FROM (SELECT {w} AS w))"
    )


_ND = r"regexp_replace(regexp_replace(regexp_extract(lower(regexp_replace(domain, '^[\s ]+|[\s ]+$', '', 'g')), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:@]*)', 1), '^\.+|\.+$', '', 'g'), '^www\.', '')"
_PATH_OF = r"coalesce(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), '')"
_SH = r"""d AS (SELECT source AS site, coalesce(lang, '') AS lang, doc_id, regexp_extract_all(lower(text), '([a-z0-9'']+)', 1) AS w, len(list_filter(regexp_split_to_array(text, '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> '')) AS words FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
s AS (SELECT site, lang, doc_id, list_distinct(list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i:i + 5], ' '))) AS s FROM d WHERE words >= 80)"""
#: The shingles of every document: characters of scripts without spaces are words of their own.
_ALL = r"""w AS (SELECT coalesce(source, '') AS site, coalesce(lang, '') AS lang, doc_id, regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])', ' \1 ', 'g'), '[\p{L}\p{M}\p{N}'']+') AS w,
trim(regexp_replace(coalesce(text, ''), '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS t FROM documents),
s AS (SELECT site, lang, doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN w WHEN t <> '' THEN [t] ELSE [] END)) AS s FROM w),
k AS (SELECT site, lang, s, min(doc_id) AS id FROM s GROUP BY ALL), e AS (SELECT site, lang, id, len(s) AS n, unnest(s) AS h FROM k),
j AS (SELECT a.site, a.lang, a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.site = b.site AND a.lang = b.lang AND a.h = b.h AND a.id < b.id GROUP BY ALL),
x AS (SELECT site, lang, a, b, round(c::DOUBLE / (na + nb - c), 6) AS similarity FROM j WHERE c::DOUBLE / (na + nb - c) >= 0.8)"""
SQL = {
    "near_duplicate_pairs": f"WITH {_ALL} SELECT * FROM x",
    "near_descriptions": f"""WITH {_ALL.replace("coalesce(source, '') AS site, coalesce(lang, '') AS lang, doc_id", "'' AS site, '' AS lang, page_id AS doc_id").replace("coalesce(text, '')", "description").replace("FROM documents", "FROM pages WHERE description IS NOT NULL")} SELECT a, b, similarity FROM x""",
    "near_duplicate_classes": f"""WITH {_ALL}, l AS (SELECT site, lang, a AS id FROM x UNION ALL SELECT site, lang, b FROM x)
SELECT s.doc_id, k.id AS class_id, (SELECT count(*) FROM l WHERE l.site = k.site AND l.lang = k.lang AND l.id = k.id) AS n_links FROM s JOIN k ON s.site = k.site AND s.lang = k.lang AND s.s = k.s""",
    "keyphrase_counts": f"WITH p AS (SELECT doc_id, unnest({_phrases('text')}) AS phrase FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, phrase, count(*) AS c FROM p GROUP BY 1, 2) SELECT phrase, CAST(sum(c) AS BIGINT) AS occurrences, count(*) AS n_texts FROM c GROUP BY 1",
    "shingle_frequency": f"WITH {_SH}, e AS (SELECT site, lang, unnest(s) AS shingle FROM s) SELECT site, lang, shingle, count(*) AS n_texts FROM e GROUP BY ALL HAVING count(*) > 1",
    "boilerplate_median": f"""WITH {_SH}, n AS (SELECT site, lang, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) >= 3), e AS (SELECT site, lang, doc_id, unnest(s) AS h FROM s), f AS (SELECT site, lang, h, count(*) AS df FROM e GROUP BY ALL),
o AS (SELECT s.site, s.lang, n, s.doc_id, count(*) FILTER (f.df IS NOT NULL AND f.df < greatest(2, floor(n * 0.8))) AS own FROM s JOIN n USING (site, lang) LEFT JOIN e ON e.doc_id = s.doc_id LEFT JOIN f ON f.site = s.site AND f.lang = s.lang AND f.h = e.h GROUP BY ALL)
SELECT site, lang, list_sort(list(own))[n // 2 + 1] AS median_own, n AS n_texts FROM o GROUP BY site, lang, n""",
    "repeated_sentences": r"""WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND len(list_filter(regexp_split_to_array(text, '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> '')) >= 150),
s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])[\s\x0B]+', '\1' || chr(1), 'g'), chr(1))) AS s FROM d),
k AS (SELECT doc_id, lower(trim(s)) AS sentence, count(*) AS n FROM s WHERE len(string_split(trim(regexp_replace(s, '[\s\x0B]+', ' ', 'g')), ' ')) >= 12 GROUP BY 1, 2 HAVING count(*) > 1)
SELECT doc_id, count(*) AS n_repeated, max(n) AS most FROM k GROUP BY 1""",
    "keyword_prominence": rf"""WITH RECURSIVE p AS (SELECT page_id, {_ND} AS site, title, description, url, h1 FROM pages WHERE source <> 'sweep' AND word_count > 0),
z AS (SELECT coalesce(site, '') AS site, 'title' AS zone, 5 AS w, 2 AS most, title AS t FROM p UNION ALL SELECT coalesce(site, ''), 'meta', 3, 2, description FROM p UNION ALL SELECT coalesce(site, ''), 'url', 2, 2, translate({_PATH_OF}, '/-_', '   ') FROM p UNION ALL SELECT coalesce(site, ''), 'h1', 4, 2, unnest(h1) FROM p),
n AS (SELECT row_number() OVER () AS i, * FROM z WHERE t IS NOT NULL AND t <> ''), g AS (SELECT i, site, zone, w, most, unnest({_phrases('t')}) AS term FROM n), c AS (SELECT i, site, zone, w, most, term, count(*) AS c FROM g GROUP BY ALL),
d AS (SELECT site, term, CAST(sum(w * least(c, most)) AS BIGINT) AS score, list_sort(list_distinct(list(zone))) AS zones FROM c GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, length(term) DESC, term) AS rn, list_distinct(string_split(term, ' ')) AS ws FROM d),
f(site, rn, kept, terms) AS (SELECT DISTINCT site, 0::BIGINT, []::VARCHAR[][], []::VARCHAR[] FROM r
UNION ALL SELECT f.site, r.rn, CASE WHEN k THEN list_append(kept, ws) ELSE kept END, CASE WHEN k THEN list_append(terms, term) ELSE terms END FROM f JOIN r ON r.site = f.site AND r.rn = f.rn + 1,
LATERAL (SELECT len(kept) < 12 AND len(list_filter(kept, lambda o: list_has_all(o, ws) AND len(o) > len(ws))) = 0 AS k) WHERE len(kept) < 12),
l AS (SELECT site, last(terms ORDER BY rn) AS terms FROM f GROUP BY 1), o AS (SELECT site, unnest(terms) AS term, unnest(range(1, len(terms) + 1)) AS place FROM l)
SELECT o.site, CAST(place AS INTEGER) AS place, o.term, score, CAST(round_even(100.0 * score / max(score) OVER (PARTITION BY o.site), 0) AS INTEGER) AS prominence, zones, 0::BIGINT AS body_count FROM o JOIN d ON d.site = o.site AND d.term = o.term""",
    "title_concentration": rf"""WITH p AS (SELECT page_id, coalesce({_ND}, '') AS site, list_filter(list_transform(string_split(regexp_replace(title, '(?i)\s*[|»:]\s+|\s+[-–—·]\s+|\s+by\s+', chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS parts FROM pages WHERE title IS NOT NULL AND trim(title) <> ''),
n AS (SELECT site, count(*) AS total FROM p GROUP BY 1 HAVING count(*) >= 10), e AS (SELECT site, unnest([lower(parts[1]), lower(parts[-1])]) AS seg FROM p WHERE len(parts) >= 2),
b AS (SELECT site, seg FROM e JOIN n USING (site) GROUP BY site, seg, total HAVING count(*) >= greatest(3.0, total * 0.4)), g AS (SELECT p.site, total, page_id, unnest(parts) AS part FROM p JOIN n USING (site)),
o AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.site = g.site AND b.seg = lower(part))), f AS (SELECT site, total, page_id, unnest({_phrases('part')}) AS phrase FROM o),
c AS (SELECT site, total, phrase, count(DISTINCT page_id) AS n FROM f WHERE phrase LIKE '% %' AND phrase NOT LIKE '% % %' GROUP BY ALL HAVING count(DISTINCT page_id) < total * 0.9),
t AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, length(phrase), phrase) AS rn FROM c) SELECT site, phrase, n AS n_pages, total FROM t WHERE rn = 1 AND n >= 5 AND n >= total * 0.15""",
}
