"""Records that differ only in formatting, as one record with its number of copies.

Characters, case, punctuation, white space and the order of fields are made canonical by built-in
expressions, the canonical text is hashed to 128 bits, and counts and least ids are aggregated with map-side
combining, so a group of copies that holds a third of all rows arrives as a few rows. An independent third
hash is part of the group key: texts that collide in 128 bits but differ in it stay apart
(:func:`collisions` counts them).

Copies meet their group in a join. Groups above ``HOT_SHARE`` of all rows number at most ``1 / HOT_SHARE``,
so their keys are broadcast; all other groups are bounded by that share and are joined by a shuffle.

Defined cases: a null key field is compared as it is given by the caller; ids must be unique, ties in nothing
else matter; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A group with more than this share of the rows is met by broadcast.
HOT_SHARE = 0.001


def canonical_text(col: Column) -> Column:
    """Only letters and digits, in lower case."""
    return F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", "")


def canonical_url(col: Column) -> Column:
    """The canonical text before the first '?', then the sorted canonical parameters that aren't empty."""
    cut = F.instr(col, "?")
    head = F.when(cut > 0, F.substring(col, F.lit(1), cut - 1)).otherwise(col)
    params = F.when(cut > 0, F.split(F.regexp_replace(F.lower(F.substring(col, cut + 1, F.length(col))), r"[^\p{L}\p{N}&]+", ""), "&"))
    named = F.array_join(F.array_sort(F.filter(params, lambda p: p != "")), "&")
    return F.concat_ws("?", canonical_text(head), F.nullif(named, F.lit("")))


def hashed(df: DataFrame, id_col: str, exact: list[Column], canonical: Column) -> DataFrame:
    """(id, h1, h2, check): 128 bits and an independent check of the exact fields and the canonical text."""
    own = df.select(F.col(id_col).alias("id"), *(c.alias(f"_k{i}") for i, c in enumerate(exact)), canonical.alias("_c"))
    keys = [F.col(f"_k{i}") for i in range(len(exact))]
    return own.select("id", F.xxhash64(*keys, "_c").alias("h1"), F.xxhash64(F.lit(0x5EED), "_c", *keys).alias("h2"), F.hash("_c", *keys).alias("check"))


def copy_groups(rows: DataFrame) -> DataFrame:
    """h1, h2, check, kept (least id), n_copies of each group."""
    return rows.groupBy("h1", "h2", "check").agg(F.min("id").alias("kept"), F.count("*").alias("n_copies"))


def collisions(groups: DataFrame) -> DataFrame:
    """Groups that share 128 bits and differ in the check: h1, h2, n_groups."""
    return groups.groupBy("h1", "h2").agg(F.count("*").alias("n_groups")).where("n_groups > 1")


def copies_of(rows: DataFrame, n_rows: int) -> DataFrame:
    """kept_id, copy_id of every row that isn't the kept one of its group."""
    groups = copy_groups(rows).where("n_copies > 1")
    hot_rows = max(1000, int(n_rows * HOT_SHARE))
    keys = ["h1", "h2", "check"]
    hot = F.broadcast(groups.where(F.col("n_copies") > hot_rows).select(*keys, F.col("kept").alias("hot_kept")))
    told = rows.join(hot, keys, "left")
    of_hot = told.where("hot_kept is not null").select(F.col("hot_kept").alias("kept_id"), F.col("id").alias("copy_id"))
    of_rest = told.where("hot_kept is null").select("id", *keys).join(groups.where(F.col("n_copies") <= hot_rows), keys).select(F.col("kept").alias("kept_id"), F.col("id").alias("copy_id"))
    return of_hot.unionByName(of_rest).where("kept_id <> copy_id")
