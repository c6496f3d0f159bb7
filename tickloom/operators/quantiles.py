"""Exact quantiles per series without holding a series in one task.

A sketch first brackets each wanted rank; where every series is short, a plain aggregate then gives the answer, as it does for the short
series beside long ones. For the long ones the rows below each bracket are counted and the values inside it, about 8 n / accuracy of
them, written once. While more of them are left for a rank than a task should sort, they are counted into equal cells between the least and
the largest, on the map side, and only the cell that holds the rank is kept.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.blocks import attach
from tickloom.sources.session import settle

ACCURACY = 10_000
#: Values of one rank that a task sorts at most, and cells that more of them are counted into.
SORTED_VALUES = 20_000
CELLS = 1024


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: dict[str, tuple[str, float]],
    approx: bool = False,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per key with a column per entry of ``wanted``: name -> (column, share).

    Quantiles are linearly interpolated between neighbours. ``approx`` skips the second pass
    and returns sketch values. A key whose values are all null gets nulls.
    """
    keys = list(keys)
    if approx:
        return df.groupBy(*keys).agg(
            *[F.percentile_approx(c, p, accuracy).alias(name) for name, (c, p) in wanted.items()]
        )

    margin = 4.0 / accuracy
    items = list(wanted.items())
    columns = sorted({c for c, _ in wanted.values()})
    sketch = []
    for c in columns:
        # one sketch per column answers the bracket ends of all its quantiles
        mine = [(i, p) for i, (_, (name, p)) in enumerate(items) if name == c]
        points = [end for _, p in mine for end in (max(p - margin, 0.0), min(p + margin, 1.0))]
        ends, few = F.percentile_approx(c, points, accuracy), F.count(c) <= accuracy
        for at, (i, _) in enumerate(mine):
            sketch += [
                F.when(few, F.min(c)).otherwise(ends[2 * at]).alias(f"_lo{i}"),
                F.when(few, F.max(c)).otherwise(ends[2 * at + 1]).alias(f"_hi{i}"),
            ]
    counts = [F.count(c).alias(f"_n{j}") for j, c in enumerate(columns)]
    brackets = settle(df.groupBy(*keys).agg(*sketch, *counts), "brackets")

    most = F.greatest(*[F.col(f"_n{j}") for j in range(len(columns))], F.lit(0))
    largest, smallest = brackets.agg(F.coalesce(F.max(most), F.lit(0)), F.min(most)).first()
    # short series: an aggregate that keeps their distinct values
    shares = {c: [p for _, (name, p) in items if name == c] for c in columns}

    def listed(rows: DataFrame) -> DataFrame:
        found = rows.groupBy(*keys).agg(*[F.percentile(c, ps).alias(f"_all_{c}") for c, ps in shares.items()])
        return found.select(*keys, *[F.col(f"_all_{c}")[shares[c].index(p)].alias(name) for name, (c, p) in items])

    if largest <= accuracy:
        return listed(df)
    rows = attach(df.select(*keys, *columns), brackets, keys)
    is_long = most > accuracy
    long = _selected(rows.where(is_long), brackets.where(is_long), keys, items, columns)
    if smallest > accuracy:
        return long
    return listed(rows.where(~is_long)).unionByName(long)


def _selected(rows: DataFrame, brackets: DataFrame, keys: list[str], items: list, columns: list[str]) -> DataFrame:
    """The wanted quantiles of long series from ``brackets`` (keys, _lo_i, _hi_i, _n_j), which ``rows`` carry."""
    inside, below = [], []
    for i, (_, (c, _)) in enumerate(items):
        x, low = F.col(c), F.col(f"_lo{i}")
        inside.append(F.when(x.between(low, F.col(f"_hi{i}")), F.struct(F.lit(i).alias("i"), x.cast("double").alias("v"))))
        below += [F.count_if(x < low).alias(f"_b{i}"), F.count_if(x.between(low, F.col(f"_hi{i}"))).alias(f"_c{i}")]
    # most rows lie in no bracket and are only counted
    near = F.lit(False)
    for mark in inside:
        near = near | mark.isNotNull()
    values = rows.where(near).select(*keys, F.inline(F.array_compact(F.array(*inside))))
    values = values.select(*keys, F.col("i").alias("_i"), F.col("v").alias("_v"))

    # a rank of an interpolated quantile, and the one above it: (keys, _i, _rank)
    def wanted(i: int, c: str, p: float, up: int) -> Column:
        spot = (F.lit(p) * (F.col(f"_n{columns.index(c)}") - 1)).cast("double")
        low = F.floor(spot)
        top = F.greatest(F.col(f"_n{columns.index(c)}") - 1, F.lit(0))
        return F.struct(
            F.lit(i).alias("_i"),
            F.lit(up).alias("_up"),
            F.least(low + up, top).alias("_rank"),
            (spot - low).alias("_part"),
            F.col(f"_b{i}").alias("_below"),
            F.col(f"_lo{i}").cast("double").alias("_lo"),
            F.col(f"_hi{i}").cast("double").alias("_hi"),
            F.col(f"_c{i}").alias("_c"),
        )

    under = rows.groupBy(*keys).agg(*below)
    spots = F.array(*[wanted(i, c, p, up) for i, (_, (c, p)) in enumerate(items) for up in (0, 1)])
    ranks = settle(attach(brackets, under, keys).select(*keys, F.inline(spots)).where("_lo is not null"), "ranks")
    found = []

    def too_many() -> bool:
        return (ranks.agg(F.max("_c")).first()[0] or 0) > SORTED_VALUES

    narrow = too_many()
    if narrow:
        values = settle(values, "bracketed")
    while narrow:
        # (keys, _i, _up): the values that are left for a rank
        left = attach(values, ranks.groupBy(*keys, "_i").agg(F.collect_list(F.struct("_up", "_rank", "_below", "_lo", "_hi")).alias("_want")), [*keys, "_i"])
        left = left.select(*keys, "_i", "_v", F.inline(F.col("_want"))).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        cell = F.least(F.lit(CELLS - 1), F.floor(F.try_divide((F.col("_v") - F.col("_lo")) * CELLS, F.col("_hi") - F.col("_lo"))))
        cells = left.groupBy(*keys, "_i", "_up", F.coalesce(cell, F.lit(0)).alias("_cell")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.first("_below").alias("_below"), F.first("_rank").alias("_rank")
        )
        # CELLS rows of a rank at most
        by_cell = Window.partitionBy(*keys, "_i", "_up").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
        upto = cells.withColumn("_upto", F.col("_below") + F.sum("_c").over(by_cell)).where("_upto > _rank and _upto - _c <= _rank")
        held = settle(upto.select(*keys, "_i", "_up", "_rank", (F.col("_upto") - F.col("_c")).alias("_below"), F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), "_c"), "rank-cells")
        found.append(held.where("_lo = _hi").select(*keys, "_i", "_up", F.col("_lo").alias("_value")))
        ranks = held.where("_lo < _hi")
        narrow = too_many()
    last = attach(values, ranks.groupBy(*keys, "_i").agg(F.collect_list(F.struct("_up", "_rank", "_below", "_lo", "_hi")).alias("_want")), [*keys, "_i"])
    last = last.select(*keys, "_i", "_v", F.inline(F.col("_want"))).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    picked = F.element_at(F.sort_array(F.collect_list("_v")), (F.first("_rank") - F.first("_below") + 1).cast("int"))
    out = last.groupBy(*keys, "_i", "_up").agg(picked.alias("_value"))
    for more in found:
        out = out.unionByName(more)
    pairs = out.groupBy(*keys, "_i").agg(F.max(F.when(F.col("_up") == 0, F.col("_value"))).alias("_a"), F.max(F.when(F.col("_up") == 1, F.col("_value"))).alias("_b"))

    columns_of = []
    for i, (name, (c, p)) in enumerate(items):
        spot = (F.lit(p) * (F.col(f"_n{columns.index(c)}") - 1)).cast("double")
        pair, part = F.element_at("_pairs", F.lit(i)), spot - F.floor(spot)
        # weighted as Spark's percentile does, so that both paths agree to the last digit
        whole = (part == 0) | (pair["_a"] == pair["_b"])
        columns_of.append(F.when(whole, pair["_a"]).otherwise((1 - part) * pair["_a"] + part * pair["_b"]).alias(name))
    by_key = pairs.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_i", F.struct("_a", "_b")))).alias("_pairs"))
    # keys with no value at all have no pairs
    return attach(brackets, settle(by_key, "quantiles"), keys).select(*keys, *columns_of)
