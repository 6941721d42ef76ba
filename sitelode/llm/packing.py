"""Fills containers of fixed capacity with items of varying length.

Multiway differencing. Items are dealt to blocks of a bounded number of containers by a hash of their id, and
each block is packed for itself. In a block every item begins as a partition of its own into k windows; the two
partial partitions of the largest difference between their windows are merged, the fullest window of the one
with the emptiest of the other, until one partition is left, whose windows are near equal. k begins at the
least number that could do; whenever a window is above the capacity, k rises by one and the block is packed anew.

An item above the capacity alone is cut into containers that it fills, and its rest is packed as an item.

Defined cases: null and empty texts have no tokens and lie in a container without taking space; ids must be
unique; equal sizes are ordered by id, so the result is the same in every run; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Containers in a block, about; bounds a task's work and wastes at most about one container in so many.
BLOCK_CONTAINERS = 128
#: Items in a block, about, however small they are.
BLOCK_ITEMS = 50_000


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indexes of the items of each of k windows with near equal sums."""
    n = len(sizes)
    if k == 1 or n <= 1:
        return [list(range(n)), *([] for _ in range(k - 1))]
    left, right = [-1] * n, [-1] * n  # how windows were joined; the first n are single items
    # A partition: its non-empty windows, fullest first, as (sums, references). An empty window isn't kept.
    parts = [(np.array([s], np.int64), np.array([i])) for i, s in enumerate(sizes)]
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        (sa, ra), (sb, rb) = parts[a], parts[b]
        shared = len(sa) + len(sb) - k
        if shared > 0:  # the emptiest of the one meet the fullest of the other
            joint = sa[-shared:] + sb[-shared:][::-1]
            refs = np.arange(len(left), len(left) + shared)
            left += ra[-shared:].tolist()
            right += rb[-shared:][::-1].tolist()
            s, r = np.concatenate([sa[:-shared], sb[:-shared], joint]), np.concatenate([ra[:-shared], rb[:-shared], refs])
        else:
            s, r = np.concatenate([sa, sb]), np.concatenate([ra, rb])
        order = np.argsort(-s, kind="stable")
        parts[a], parts[b] = (s[order], r[order]), None
        spread = int(s[order[0]]) - (int(s[order[-1]]) if len(s) == k else 0)
        heapq.heappush(heap, (-spread, a))
    windows = []
    for ref in parts[heap[0][1]][1].tolist():
        items, stack = [], [ref]
        while stack:
            x = stack.pop()
            if x < n:
                items.append(x)
            else:
                stack += [left[x], right[x]]
        windows.append(items)
    return windows + [[] for _ in range(k - len(windows))]


def pack_block(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of item indexes, none above the capacity. Sizes lie between 1 and the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return [w for w in windows if w]
        k += 1


OUT = "profile_id int, capacity_tokens int, container_id string, item_id long, piece_no int, start_token long, n_tokens long"


def _pack_group(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    profile, capacity, block = (x.as_py() for x in key)
    group = group.sort_by([("n", "descending"), ("item_id", "ascending")])
    sizes, ids, starts, pieces = (group.column(c).to_pylist() for c in ("n", "item_id", "start_token", "piece_no"))
    windows = pack_block(sizes, capacity)
    rows = [(profile, capacity, f"b{block}-{w}", ids[i], pieces[i], starts[i], sizes[i]) for w, own in enumerate(windows) for i in own]
    types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    names = ["profile_id", "capacity_tokens", "container_id", "item_id", "piece_no", "start_token", "n_tokens"]
    return pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)


def pack(sizes: DataFrame, id_col: str, size_col: str, profiles: dict[int, int]) -> DataFrame:
    """One row for each piece of each item and profile, with its container; ``profiles`` maps ids to capacities.

    ``sizes`` is read twice; hand in a written table.
    """
    caps = sorted(profiles.items())
    if not caps:
        return sizes.sparkSession.createDataFrame([], OUT)
    rests = sizes.agg(*(F.coalesce(F.sum(F.col(size_col) % cap), F.lit(0)).alias(f"s{i}") for i, (_, cap) in enumerate(caps)), F.count("*").alias("n")).first()
    least = -(-rests["n"] // BLOCK_ITEMS)
    plans = [F.struct(F.lit(p).cast("int").alias("profile_id"), F.lit(cap).cast("int").alias("capacity_tokens"), F.lit(max(1, least, -(-rests[i] // (cap * BLOCK_CONTAINERS)))).cast("long").alias("blocks")) for i, (p, cap) in enumerate(caps)]
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    items = sizes.select(F.col(id_col).cast("long").alias("item_id"), size.alias("size"), F.explode(F.array(*plans)).alias("x")).select("item_id", "size", "x.*")
    cap = F.col("capacity_tokens").cast("long")
    whole = F.expr("size div capacity_tokens")
    full = items.where(whole > 0).select("profile_id", "capacity_tokens", "item_id", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("i"))
    full = full.select("profile_id", "capacity_tokens", F.concat(F.lit("i"), F.col("item_id"), F.lit("-"), F.col("i")).alias("container_id"), "item_id", F.col("i").cast("int").alias("piece_no"), (F.col("i") * cap).alias("start_token"), cap.alias("n_tokens"))
    block = F.pmod(F.xxhash64("item_id"), F.col("blocks"))
    rest = items.where(F.col("size") % cap > 0).select("profile_id", "capacity_tokens", block.alias("block"), "item_id", whole.cast("int").alias("piece_no"), (whole * cap).alias("start_token"), (F.col("size") % cap).alias("n"))
    # Items without size lie in the first container of their block; they need no task.
    zero = F.lit(0).cast("long")
    blank = items.where("size = 0").select("profile_id", "capacity_tokens", F.concat(F.lit("b"), block, F.lit("-0")).alias("container_id"), "item_id", F.lit(0).alias("piece_no"), zero.alias("start_token"), zero.alias("n_tokens"))
    return full.unionByName(rest.groupBy("profile_id", "capacity_tokens", "block").applyInArrow(_pack_group, OUT)).unionByName(blank)


def fill_report(packed: DataFrame) -> DataFrame:
    """Containers, tokens and the share of space used, by profile."""
    used = packed.groupBy("profile_id", "capacity_tokens").agg(F.count_distinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return used.withColumn("used_share", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")))
