"""Sharding by a minimax partition of atomic groups in a fixed order.

Rows with equal texts form a group that stays together. Groups are ordered by digest; the shards are runs of
that order. The capacity is the smallest one for which filling the shards greedily, each up to the capacity,
places all groups: it is found by search, each check being seven steps along the prefix sums.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import spare
from tickloom.sources.session import settle

SHARDS = 8
#: Capacities checked at the same time: each round cuts the range of the search by this number plus one.
PROBES = 48
#: Parts of the digest order, and parts of a shard when its rows are numbered.
BUCKETS = 4096
CELLS = 4096


def _bucket(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def prefix_sums(groups: DataFrame) -> DataFrame:
    """(digest, size, upto): ``upto`` is the size of all groups up to this one, in the order of digests.

    Sums run inside 4096 parts of the digest order; one row per part carries the rest. Digests of different
    texts spread evenly, so parts do too, and no part depends on how often a text occurs.
    """
    parted = groups.withColumn("bucket", _bucket(F.col("digest")))
    inside = Window.partitionBy("bucket").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over 4096 rows at most
    totals = parted.groupBy("bucket").agg(F.sum("size").alias("total"))
    before = totals.select("bucket", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("before"))
    summed = parted.withColumn("within", F.sum("size").over(inside))
    return summed.join(before, "bucket").select("digest", "size", (F.col("before") + F.col("within")).alias("upto"))


def _steps(sums: DataFrame, largest: int, total: int, capacities: list[int], shards: int) -> list[list[int]]:
    """For each capacity, how far each shard reaches when filled greedily."""
    reach = [[0] for _ in capacities]
    for _ in range(shards):
        ends = [min(r[-1] + c, total) for r, c in zip(reach, capacities, strict=True)]
        if all(e == total for e in ends):
            found = ends
        else:
            # the last group that fits ends less than one group before the limit
            near = sums.where(F.col("upto").between(min(ends) - largest, max(ends)))
            fits = [F.max(F.when(F.col("upto") <= e, F.col("upto"))).alias(f"e{i}") for i, e in enumerate(ends)]
            found = near.agg(*fits).first()
        for r, f in zip(reach, found, strict=True):
            r.append(max(r[-1], f or 0))
    return [r[1:] for r in reach]


def minimax_cuts(sums: DataFrame, shards: int = SHARDS) -> list[int]:
    """Where shards end, as prefix sums, for the smallest feasible capacity."""
    top = sums.agg(F.max("upto"), F.max("size")).first()
    total, largest = top[0] or 0, top[1] or 0
    low, high = max(largest, -(-total // shards)), -(-total // shards) + largest  # the upper one always suffices
    best = None
    while low < high or best is None:
        width = high - low
        probes = sorted({low + width * i // (PROBES - 1) for i in range(PROBES)}) if width >= PROBES else list(range(low, high + 1))
        for capacity, reach in zip(probes, _steps(sums, largest, total, probes, shards), strict=True):
            if reach[-1] >= total:
                high, best = capacity, reach
                break
            low = capacity + 1
    return best


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with ``_digest``, ``_size``, ``_shard`` (0 to ``shards`` - 1) and ``_slot`` (gapless from 0 in each shard).

    The size of a row is the UTF-8 length of ``text`` plus 1, a null text has length 0. Equal texts share a
    shard, null counts as equal to empty. With fewer groups than shards the last shards stay empty; an empty table gives an
    empty table. Slots follow a hash of ``doc_id``, then the id and text, so they don't depend on the
    partitioning; repeated rows get adjacent slots. All columns pass unchanged, but for ones named like the four results.
    """
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = docs.withColumns({"_digest": F.sha2(body, 256), "_size": (F.octet_length(body) + 1).cast("long")})
    groups = sized.groupBy(F.col("_digest").alias("digest")).agg(F.sum("_size").alias("size"))
    sums = settle(prefix_sums(groups), "prefix-sums")
    cuts = minimax_cuts(sums, shards)
    last = sums.where(F.col("upto").isin(sorted(set(cuts)))).select("upto", "digest").collect()  # a row per shard at most
    ends = sorted(digest for _, digest in last)
    place = {digest: i for i, digest in enumerate(ends)}
    number = F.lit(len(ends) - 1)
    for digest in reversed(ends[:-1]):
        number = F.when(F.col("_digest") <= digest, place[digest]).otherwise(number)
    cell, at, before = spare(docs, "_cell", "_at", "_before")
    placed = sized.withColumns({"_shard": number.cast("int"), cell: F.pmod(F.xxhash64("doc_id", "_digest"), F.lit(CELLS)).cast("int")})
    counts = placed.groupBy("_shard", cell).agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("_shard").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)  # over 4096 rows at most
    offsets = counts.select("_shard", cell, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias(before))
    order = Window.partitionBy("_shard", cell).orderBy("doc_id", "_digest")
    numbered = placed.withColumn(at, F.row_number().over(order)).join(offsets, ["_shard", cell])
    own = ("_digest", "_size", "_shard", "_slot")
    passed = [c for c in docs.columns if c not in own]
    return numbered.select(*passed, *own[:3], (F.col(before) + F.col(at) - 1).alias("_slot"))
