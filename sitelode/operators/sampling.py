"""Evenly spread and stratified samples, and distributed row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelode.session import cut


def indexed(df: DataFrame, keys: list[str], order: list[str], name: str = "i") -> DataFrame:
    """``df`` with each row's place (from 0) among the rows of its keys, and their number as ``n``.

    Rows are range-partitioned by keys and order, so a key with very many rows is spread over tasks; each
    task numbers its own part, and the parts' sizes, a few rows a task, add up to the offsets.
    """
    parts = cut(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy(*keys, "_part").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).withColumn("n", F.sum("_c").over(Window.partitionBy(*keys))).drop("_c")
    own = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1
    return parts.withColumn("_own", own).join(sizes, [*keys, "_part"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def spread(i: Column, n: Column, k: Column) -> Column:
    """Whether place i of n is one of k evenly spaced ones: floor(x * (n / k)) for some x below k."""
    step = n.cast("double") / k
    x = F.ceil(i / step)
    near = F.array(x - 1, x, x + 1)
    return (k >= n) | F.exists(near, lambda y: (y >= 0) & (y < k) & (F.floor(y * step) == i))


def stratified(df: DataFrame, group: list[str], stratum: str, order: list[str], size: int) -> DataFrame:
    """A sample of ``size`` rows of each group: one slot a stratum in turn, largest strata first, spread evenly inside each."""
    rows = indexed(df, [*group, stratum], order)
    strata = rows.where("i = 0").select(*group, stratum, F.least("n", F.lit(size)).alias("_cap"), "n", *(F.col(o).alias(f"_o{j}") for j, o in enumerate(order)))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), *(f"_o{j}" for j in range(len(order)))))
    # A stratum beyond the first ``size`` gets no slot, which bounds the slots of a group.
    ranked = strata.withColumn("_rank", rank).where(F.col("_rank") <= size)
    slots = ranked.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_cap").cast("int") - 1)))
    turn = F.row_number().over(Window.partitionBy(*group).orderBy("_j", "_rank"))
    quota = slots.withColumn("_turn", turn).where(F.col("_turn") <= size).groupBy(*group, stratum).agg(F.count("*").alias("k"))
    return rows.join(quota, [*group, stratum]).where(spread(F.col("i"), F.col("n"), F.col("k"))).drop("i", "n", "k")
