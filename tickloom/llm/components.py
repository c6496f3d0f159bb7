"""Connected components of a graph given as edges."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.sources.session import settle

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): ``root`` is the least node that can be reached.

    Alternates the large-star and small-star steps until the edges are stars: each step ties a node's
    neighbours to their least one. Nodes are aggregated before they are joined, so a node with many
    neighbours costs its edges, never pairs of them. Every step is a written table; the driver sees sums only.
    """
    now = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(ROUNDS):
        both = now.union(now.select("v", "u"))
        least = both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, both["u"] == least["x"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = settle(large, "large-star")
        least = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        tied = large.join(least, large["u"] == least["x"])
        small = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("x", "m")).distinct()
        now = settle(small, "small-star")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise ValueError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
