"""Frequencies of all n-grams of term sequences: occurrences, and records that hold them.

Suffix-sorted counting. Each record emits one suffix for each position, cut to ``max_n`` terms, instead of
every n-gram. Suffixes are combined where they are read, routed by their first terms, sorted in reverse
lexicographic order, and one pass with a stack of open prefixes sums up all prefixes of all suffixes: one exchange.
``max_n = 1`` counts values.

Records without record sets. A record's own suffixes are sorted too. What a suffix shares with the one before it
has been counted for the record there; every longer prefix is new. So one number a suffix, ``new_from``, says from
which length on its prefixes count for the record: it takes one sort of the record, however long that is. Equal
suffixes then merge into (suffix, new_from, count), so a term that fills a third of all rows arrives as a few rows
from each task, and no set of record ids is ever held.

Routing uses the first term and a bucket of the second. Only prefixes of length one can be in several
buckets, at most ``SPREAD`` of them, so a frequent first term is spread over tasks; a last sum merges those.

Defined cases: null terms are no terms, but split the sequence (no n-gram runs across one); empty strings
are terms as they stand; null and empty sequences give nothing; repeated rows each count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of second terms that share a first term.
SPREAD = 16


def domain_key(col: str | Column) -> Column:
    """The domain in lower case, without what is neither letter nor digit at its ends; null if nothing is left."""
    c = F.col(col) if isinstance(col, str) else col
    key = F.regexp_replace(F.lower(c), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.when(key != "", key)


def _suffixes(df: DataFrame, group: str, terms: str, max_n: int) -> DataFrame:
    """(group, t1..tn, new_from) of each position that holds a term; JVM only, one sort of each record."""
    gap = "array_position(transform(g, y -> y IS NULL), true)"
    cut = f"transform(transform(_t, (x, i) -> slice(_t, i + 1, {max_n})), g -> IF({gap} > 0, slice(g, 1, CAST({gap} AS INT) - 1), g))"
    ordered = df.select(group, F.col(terms).alias("_t")).select(group, F.expr(f"array_sort(filter({cut}, g -> size(g) > 0))").alias("_s"))
    shared = "aggregate(sequence(1, least(size(get(_s, i - 1)), size(g))), 0, (k, j) -> IF(k = j - 1 AND get(_s, i - 1)[j - 1] = g[j - 1], j, k))"
    rows = ordered.select(group, F.explode(F.expr(f"transform(_s, (g, i) -> struct(g, CAST(IF(i = 0, 0, {shared}) + 1 AS BYTE) AS new_from))")).alias("_x"))
    return rows.select(group, *(F.expr(f"try_element_at(_x.g, {i + 1})").alias(f"t{i + 1}") for i in range(max_n)), F.col("_x.new_from").alias("new_from"))


#: Rows that a task combines before it hands them on.
COMBINE_ROWS = 400_000


def _combined(rows: DataFrame) -> DataFrame:
    """Equal rows of a task merged to one with their number, as ``c``: a map-side combine that leaves the routing of the exchange free."""
    schema = T.StructType([*rows.schema.fields, T.StructField("c", T.LongType())])
    names = rows.columns

    def merge(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by(names, use_threads=False).aggregate([("c", "sum")]).select([*names, "c_sum"]).rename_columns([*names, "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n = 0
        for batch in batches:
            held.append(pa.table([*batch.columns, pa.array(np.ones(batch.num_rows, np.int64))], [*names, "c"]))
            n += batch.num_rows
            if n >= COMBINE_ROWS:
                merged = merge(held)
                # What doesn't shrink any more is handed on.
                if merged.num_rows > COMBINE_ROWS // 2:
                    yield from merged.to_batches(max_chunksize=10_000)
                    held, n = [], 0
                else:
                    held, n = [merged], merged.num_rows
        if held:
            yield from merge(held).to_batches(max_chunksize=10_000)

    return rows.mapInArrow(run, schema)


def _stack(max_n: int, group_type: pa.DataType):
    """The pass over sorted suffixes: open prefixes are kept between batches, a whole batch is summed at once."""
    names = ["group_name", "n", *(f"t{i + 1}" for i in range(max_n)), "occurrences", "records"]
    types = [pa.string(), pa.int8(), *[pa.string()] * max_n, pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_at: list[tuple | None] = [None] * max_n  # (terms up to here, occurrences, records) of the prefix of each length

        def rows_to_batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i) for i in range(1 + max_n)]
            new_from, count = batch.column(1 + max_n).to_numpy(zero_copy_only=False), batch.column(2 + max_n).to_numpy(zero_copy_only=False)
            changed = np.zeros(batch.num_rows, bool)
            changed[0] = True
            done, closed = [], []
            for k in range(max_n):
                for c in (cols[:2] if k == 0 else cols[k + 1 : k + 2]):
                    same = pc.fill_null(pc.equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
                    both_null = pc.and_(pc.is_null(c[1:]), pc.is_null(c[:-1])).to_numpy(zero_copy_only=False)
                    changed[1:] |= ~(same | both_null)
                starts = np.flatnonzero(changed)
                occ = np.add.reduceat(count, starts)
                rec = np.add.reduceat(np.where(new_from <= k + 1, count, 0), starts)
                has = pc.is_valid(cols[k + 1].take(pa.array(starts))).to_numpy(zero_copy_only=False)
                at = pa.array(starts)
                terms = [c.take(at) for c in cols[: k + 2]]
                first = tuple(c[0].as_py() for c in terms)
                prev = open_at[k]
                if prev is not None:
                    if prev[0] == first and has[0]:
                        occ[0] += prev[1]
                        rec[0] += prev[2]
                    else:
                        closed.append((prev[0][0], k + 1, *prev[0][1:], *[None] * (max_n - k - 1), prev[1], prev[2]))
                open_at[k] = (tuple(c[-1].as_py() for c in terms), int(occ[-1]), int(rec[-1])) if has[-1] else None
                keep = has.copy()
                keep[-1] = False
                if keep.any():
                    mask = pa.array(keep)
                    m = int(keep.sum())
                    own = [c.filter(mask) for c in terms]
                    done.append(pa.RecordBatch.from_arrays([own[0], pa.array(np.full(m, k + 1, np.int8)), *own[1:], *[pa.nulls(m, pa.string())] * (max_n - k - 1), pa.array(occ[keep]), pa.array(rec[keep])], names))
            yield from done
            if closed:
                yield rows_to_batch(closed)
        rest = [(p[0][0], k + 1, *p[0][1:], *[None] * (max_n - k - 1), p[1], p[2]) for k, p in enumerate(open_at) if p is not None]
        if rest:
            yield rows_to_batch(rest)

    return run


def ngram_counts(df: DataFrame, terms: str, *, group: str | None = None, max_n: int = 1) -> DataFrame:
    """group_name, n, t1..t<max_n>, occurrences, records of every n-gram up to ``max_n`` terms.

    ``terms`` is an array of strings, one sequence a record; ``group`` tells apart collections that are
    counted separately.
    """
    named = df.select(F.col(group).alias("group_name") if group else F.lit("").alias("group_name"), F.col(terms).alias("_terms"))
    cols = [f"t{i + 1}" for i in range(max_n)]
    merged = _combined(_suffixes(named, "group_name", "_terms", max_n))
    route = ["group_name", "t1"] + ([F.pmod(F.xxhash64("t2"), F.lit(SPREAD))] if max_n > 1 else [])
    # Sorting is reverse lexicographic: a prefix comes after its longer suffixes.
    ordered = merged.repartition(*route).sortWithinPartitions("group_name", *(F.desc_nulls_last(c) for c in cols))
    schema = T.StructType([T.StructField("group_name", T.StringType()), T.StructField("n", T.ByteType()), *(T.StructField(c, T.StringType()) for c in cols), T.StructField("occurrences", T.LongType()), T.StructField("records", T.LongType())])
    counted = ordered.select("group_name", *cols, F.col("new_from").cast("long").alias("new_from"), "c").mapInArrow(_stack(max_n, pa.string()), schema)
    if max_n == 1:
        return counted
    spread = counted.where("n = 1").groupBy("group_name", "n", *cols).agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return counted.where("n > 1").unionByName(spread)


def marked(counts: DataFrame, rows_of: dict[str, int], *, rare_rows: int = 2, common_share: float = 0.05) -> DataFrame:
    """``counts`` with a mark: 'rare' up to ``rare_rows`` records, 'common' above ``common_share`` of the group's rows."""
    total = F.create_map(*(x for k, v in rows_of.items() for x in (F.lit(k), F.lit(v))))[F.col("group_name")]
    mark = F.when(F.col("records") <= rare_rows, "rare").when(F.col("records") > total * common_share, "common")
    return counts.withColumn("mark", mark)
