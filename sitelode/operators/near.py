"""Near-duplicate texts inside groups by exact Jaccard similarity of word shingles.

Texts with one shingle set are one class, so copies are never compared. Of each class only a prefix of its
rarest shingles is indexed: two sets of similarity s share one of the rarest ``n - ceil(s * n) + 1``, so a
shared rare shingle finds every pair. A pair is dropped in the join if its sizes rule it out, or if the shingles
left after the shared one in both can't make up the overlap that s needs. A shingle of very many texts, as
templated sites have them, is split: one side is dealt to as many salts as it has ``SPLIT`` texts, the other one
repeated for each, so no task meets all pairs of a shingle. What is left is verified on the full sets.

Keys that many texts share (an empty set, a boilerplate shingle) stand on the large side of joins whose other side
has them once, where adaptive execution splits the skewed partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelode.session import cut


def classes(df: DataFrame, group: list[str], id_col: str, shingles: str) -> tuple[DataFrame, DataFrame]:
    """(members: id, class_id; representatives: group, class_id, set of hashes, n)."""
    hashed = df.select(*group, id_col, F.array_sort(F.array_distinct(F.transform(shingles, lambda s: F.xxhash64(s)))).alias("_set"))
    keyed = cut(hashed.withColumn("_key", F.md5(F.to_json("_set"))), "sets")
    own = keyed.groupBy(*group, "_key").agg(F.min(id_col).alias("class_id"))
    members = keyed.select(*group, id_col, "_key").join(own, [*group, "_key"]).select(*group, id_col, "class_id")
    return members, keyed.join(own, [*group, "_key"]).where(F.col(id_col) == F.col("class_id")).select(*group, "class_id", F.col("_set").alias("set"), F.size("_set").alias("n")).where("n > 0")


#: Texts of one shingle that a task meets at once, about.
SPLIT = 2_000


def similar_classes(representatives: DataFrame, group: list[str], least: float) -> DataFrame:
    """group, a, b, similarity of each pair of classes with a similarity of ``least`` or more, a < b."""
    reps = cut(representatives, "classes")
    each = reps.select(*group, "class_id", "n", F.explode("set").alias("h"))
    df_ = each.groupBy(*group, "h").agg(F.count("*").alias("df"))
    # A shingle of one text alone finds nothing and stays out; those before it in the order are counted all the same.
    ranked = each.join(df_, [*group, "h"]).groupBy(*group, "class_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("r"))  # one text's own shingles
    keep = F.col("n") - F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9)) + 1
    index = ranked.select(*group, "class_id", "n", F.posexplode(F.slice("r", F.lit(1), keep.cast("int"))).alias("i", "x")).where("x.df > 1")
    index = index.select(*group, "class_id", "n", F.col("x.h").alias("h"), "i", F.ceil(F.col("x.df") / F.lit(SPLIT)).cast("int").alias("salts"))
    a = index.select(*group, "h", F.pmod(F.xxhash64("class_id"), F.col("salts")).cast("int").alias("salt"), F.col("class_id").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"))
    b = index.select(*group, "h", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("class_id").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"))
    needed = F.ceil((F.col("na") + F.col("nb")) * F.lit(least / (1 + least)) - F.lit(1e-9))
    first = F.least("ia", "ib")
    possible = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) + first >= needed
    sized = (F.col("a") < F.col("b")) & (F.col("na") >= F.col("nb") * least - 1e-9) & (F.col("nb") >= F.col("na") * least - 1e-9)
    found = a.join(b, [*group, "h", "salt"]).where(sized & possible).select(*group, "a", "b").distinct()
    full = found.join(reps.select(*group, F.col("class_id").alias("a"), F.col("set").alias("sa")), [*group, "a"]).join(reps.select(*group, F.col("class_id").alias("b"), F.col("set").alias("sb")), [*group, "b"])
    common = F.size(F.array_intersect("sa", "sb"))
    return full.withColumn("similarity", common / (F.size("sa") + F.size("sb") - common)).where(F.col("similarity") >= least).select(*group, "a", "b", "similarity")
