"""Ordered windows over long series without putting a series into one task.

A window partitioned by the series key alone sends a whole series to one task. Here a long
series is cut into blocks of consecutive rows, and each block also gets copies of the rows just
before it, as many as the longest window looks back. A window over (key, block) then sees all it
needs, so one hash shuffle on (key, block) serves every lag, rolling and decay feature at once.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.sources.session import settle

#: Cells of a grid at most, and cells of a series' grid whose counts are summed together first.
SLOTS = 4096
GROUP = 64


@dataclass(frozen=True)
class Series:
    """How rows form series: key columns, order column, and columns that break ties.

    ``block_rows`` is the number of rows of one series a single task should sort; series that
    are longer are cut. ``cut`` tells a feature that some are.
    """

    keys: tuple[str, ...] = ()
    ts: str = "ts"
    tie: tuple[str, ...] = ()
    block_rows: int = 1_000_000
    cut: bool = False

    def __post_init__(self):
        object.__setattr__(self, "keys", tuple(self.keys))
        object.__setattr__(self, "tie", tuple(self.tie))

    def order(self) -> list[Column]:
        return [F.col(c).asc() for c in (self.ts, *self.tie)]

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, "_home").orderBy(*self.order())

    def with_rows(self, block_rows: int) -> "Series":
        return replace(self, block_rows=block_rows)


def _ticks(df: DataFrame, s: Series) -> Column:
    """The order column as a number: microseconds for dates and timestamps."""
    kind = df.schema[s.ts].dataType
    c = F.col(s.ts)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(c.cast("timestamp"))
    return c.cast("double") if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)) else c.cast("long")


def attach(df: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of a one-row-per-key table; keys compare null-safe so no row is lost.

    With no keys ``side`` has one row, read as a scalar subquery.
    """
    extra = [c for c in side.columns if c not in keys]
    if not keys:
        packed = side.select(F.struct(*extra)).scalar()
        return df.withColumn("_side", packed).select(
            *df.columns, *[F.col(f"_side.{c}").alias(c) for c in extra]
        )
    renamed = side.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], *extra)
    same = None
    for i, k in enumerate(keys):
        test = F.col(k).eqNullSafe(F.col(f"_r{i}"))
        same = test if same is None else same & test
    return df.join(renamed, same, "left").drop(*[f"_r{i}" for i in range(len(keys))])


@dataclass(frozen=True)
class Layout:
    """Where the rows of long series go.

    ``start`` has the grid of each long series (keys, _lo, _hi, _parts), ``finer`` the grids of over-full cells (keys, _cell, _lo, _hi, _parts)
    level by level, and ``cells`` a row for each final cell: ``_from`` is the first row number in it, ``_block`` its block, ``_homes`` the blocks that need its rows.
    """

    start: DataFrame
    finer: tuple[DataFrame, ...]
    cells: DataFrame


def _parts(n: Column, s: Series) -> Column:
    """Cells for ``n`` rows: half a block each on average, so that few are over-full."""
    return F.greatest(F.lit(2), F.least(F.lit(SLOTS), F.ceil(n * 2 / s.block_rows))).cast("long")


def _cell() -> Column:
    """Part of the grid (_lo, _hi, _parts) that a row lies in, as text: 0 before it, then equal widths, then one behind it; -1 without a time."""
    t, lo, hi, parts = (F.col(c) for c in ("_tick", "_lo", "_hi", "_parts"))
    at = F.floor(F.try_divide((t - lo).cast("double") * parts, (hi - lo).cast("double")))
    inside = F.least(parts, F.coalesce(at, F.lit(0)).cast("long") + 1)
    return F.when(t.isNull(), -1).when(t < lo, 0).when(t > hi, parts + 1).otherwise(inside).cast("string")


def _finer(rows: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the cells of those in the grid's cells cut further."""
    out = attach(rows, grid, [*keys, "_cell"])
    deeper = F.when(F.col("_parts").isNotNull(), F.concat(F.col("_cell"), F.lit("/"), _cell())).otherwise(F.col("_cell"))
    return out.withColumn("_cell", deeper).drop("_lo", "_hi", "_parts")


def block_layout(df: DataFrame, s: Series, back: int) -> Layout | None:
    """Blocks of the long series, or None when every series fits one task.

    Each long series has its own grid over its own times. Row counts per (key, cell) are combined on the map side; only cells with more rows than
    a block are cut again, between the hundredths at either end of their times, so that a burst is found at once and calm stretches keep
    their few cells. Prefix sums of the counts go by groups of cells, and only the groups' sums by series. The driver gets scalars.
    """
    keys = list(s.keys)
    timed = df.select(*keys, _ticks(df, s).alias("_tick"))
    per_key = timed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_tick").alias("_lo"), F.max("_tick").alias("_hi"))
    top = per_key.agg(F.max("n").alias("n"), F.max("_hi").alias("hi")).first()
    if top.n is None or top.n <= s.block_rows or top.hi is None:
        return None

    start = settle(per_key.where(F.col("n") > s.block_rows).select(*keys, "_lo", "_hi", _parts(F.col("n"), s).alias("_parts")), "long-series")
    rows = attach(timed, start, keys).where("_parts is not null").withColumn("_cell", _cell()).select(*keys, "_tick", "_cell")
    done, finer = [], []
    while True:
        counts = rows.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_rows"), F.min("_tick").alias("_first"), F.max("_tick").alias("_last"))
        counts = settle(counts, "cells")
        # rows of one instant stay together
        full = F.coalesce((F.col("_rows") > s.block_rows) & (F.col("_first") < F.col("_last")), F.lit(False))
        done.append(counts.where(~full).select(*keys, "_cell", "_rows", "_first"))
        over = counts.where(full).select(*keys, "_cell", F.lit(True).alias("_over"))
        if over.isEmpty():
            break
        rows = attach(rows, over, [*keys, "_cell"]).where("_over").drop("_over")
        ends = rows.groupBy(*keys, "_cell").agg(F.percentile_approx("_tick", [0.01, 0.99], 1000).alias("p"), F.count(F.lit(1)).alias("n"))
        grid = settle(ends.select(*keys, "_cell", F.col("p")[0].alias("_lo"), F.col("p")[1].alias("_hi"), _parts(F.col("n"), s).alias("_parts")), "finer-cells")
        finer.append(grid)
        rows = _finer(rows, grid, keys)

    cells = done[0]
    for more in done[1:]:
        cells = cells.unionByName(more)
    cells = cells.withColumn("_group", F.floor(F.substring_index("_cell", "/", 1).cast("long") / GROUP))
    # a row for each group, some sixty of a series
    by_group = Window.partitionBy(*keys).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = cells.groupBy(*keys, "_group").agg(F.sum("_rows").alias("_sum"))
    groups = groups.select(*keys, "_group", F.coalesce(F.sum("_sum").over(by_group), F.lit(0)).alias("_base"))
    by_cell = Window.partitionBy(*keys, "_group").orderBy(F.col("_first").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    summed = attach(cells.withColumn("_upto", F.sum("_rows").over(by_cell)), groups, [*keys, "_group"])
    end = F.col("_base") + F.col("_upto")
    placed = summed.select(*keys, "_cell", (end - F.col("_rows")).alias("_from"), end.alias("_end"))
    placed = placed.withColumn("_block", F.floor(F.try_divide("_from", F.lit(s.block_rows))))
    if back <= 0:
        return Layout(start, tuple(finer), settle(placed.select(*keys, "_cell", "_from", "_block", F.array("_block").alias("_homes")), "layout"))
    placed = settle(placed, "placed-cells")
    # a cell is needed by each block that begins within `back` rows of the cell's end
    blocks = placed.groupBy(*keys, F.col("_block").alias("_need")).agg(F.min("_from").alias("_start"))
    reach = F.floor(F.try_divide(F.col("_end") + back - 1, F.lit(s.block_rows)))
    needs = placed.select(*keys, "_cell", "_end", F.explode(F.when(reach > F.col("_block"), F.sequence(F.col("_block") + 1, reach))).alias("_need"))
    needs = attach(needs, blocks, [*keys, "_need"]).where(F.col("_start") < F.col("_end") + back)
    more = needs.groupBy(*keys, "_cell").agg(F.collect_list("_need").alias("_needs"))
    homes = F.concat(F.array("_block"), F.coalesce("_needs", F.array().cast("array<bigint>")))
    laid = attach(placed, more, [*keys, "_cell"]).select(*keys, "_cell", "_from", "_block", homes.alias("_homes"))
    return Layout(start, tuple(finer), settle(laid, "layout"))


def with_blocks(df: DataFrame, s: Series, back: int = 0) -> DataFrame:
    """Add ``_home`` (block), ``_own`` (false on look-back copies) and ``_pos`` (row number from 0)."""
    return _place(df, s, block_layout(df, s, back))


def _place(df: DataFrame, s: Series, layout: Layout | None) -> DataFrame:
    if layout is None:
        laid = df.withColumn("_home", F.lit(0).cast("long")).withColumn("_own", F.lit(True))
        return laid.withColumn("_pos", (F.row_number().over(s.window()) - 1).cast("long"))

    tagged = attach(df.withColumn("_tick", _ticks(df, s)), layout.start, s.keys)
    tagged = tagged.withColumn("_cell", F.when(F.col("_parts").isNotNull(), _cell())).drop("_lo", "_hi", "_parts")
    for grid in layout.finer:
        tagged = _finer(tagged, grid, s.keys)
    laid = (
        attach(tagged, layout.cells, [*s.keys, "_cell"])
        .withColumn("_home", F.explode(F.coalesce("_homes", F.array(F.lit(0).cast("long")))))
        .withColumn("_own", F.col("_home") == F.coalesce("_block", F.lit(0)))
    )
    home = Window.partitionBy(*s.keys, "_home")
    first = F.coalesce(F.min("_from").over(home), F.lit(0))
    laid = laid.withColumn("_pos", (first + F.row_number().over(s.window()) - 1).cast("long"))
    return laid.drop("_tick", "_cell", "_from", "_block", "_homes")


def own_rows(laid: DataFrame) -> DataFrame:
    return laid.where("_own").drop("_home", "_own", "_pos")


@dataclass(frozen=True)
class Feature:
    """Columns that need the ``back`` rows before each row. ``build(df, series)`` adds them.

    ``rolls`` lists the rolling aggregates (column, fold, rows) the build reads through ``rolled``;
    features that share one have it computed once.
    """

    back: int
    build: Callable[[DataFrame, Series], DataFrame]
    rolls: tuple[tuple[str, str, int], ...] = ()


FOLDS = {"avg": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def _roll_name(c: str, fold: str, n: int) -> str:
    return f"_roll_{fold}_{n}_{c}"


def rolled(c: str, fold: str, n: int) -> Column:
    """A rolling aggregate over the last n rows, null until all n have a value."""
    return F.col(_roll_name(c, fold, n))


def add_features(df: DataFrame, s: Series, *features: Feature) -> DataFrame:
    """Add all features with one layout and one shuffle by (key, block)."""
    layout = block_layout(df, s, max((f.back for f in features), default=0))
    laid, s = _place(df, s, layout), replace(s, cut=layout is not None)
    rolls = list(dict.fromkeys(roll for f in features for roll in f.rolls))
    if rolls:
        frames = {n: rows_back(s, n) for _, _, n in rolls}
        complete = {(c, n): F.count(c).over(frames[n]) == n for c, _, n in rolls}
        laid = laid.withColumns(
            {_roll_name(c, fold, n): F.when(complete[c, n], FOLDS[fold](c).over(frames[n])) for c, fold, n in rolls}
        )
    for f in features:
        laid = f.build(laid, s)
    return own_rows(laid).drop(*[_roll_name(*roll) for roll in rolls])


def rows_back(s: Series, n: int) -> WindowSpec:
    """The current row and the n-1 before it."""
    return s.window().rowsBetween(-(n - 1), 0)


def numbered(df: DataFrame, s: Series) -> DataFrame:
    """Add ``pos`` (row number from 0) and ``n`` (rows in the series)."""
    layout = block_layout(df, s, 0)
    laid = _place(df, s, layout).withColumnRenamed("_pos", "pos")
    if layout is None:
        laid = laid.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*s.keys, "_home")))
        return laid.drop("_home", "_own")
    totals = settle(df.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("n")), "totals")
    return attach(laid.drop("_home", "_own"), totals, s.keys)


def running(
    df: DataFrame,
    s: Series,
    wanted: dict[str, tuple[str, str]],
    pos: bool = False,
    layout: Layout | None | str = "find",
) -> DataFrame:
    """Prefix results over whole series: name -> (kind, column).

    Kinds: ``sum``, ``min``, ``max``; ``last`` and ``next`` give struct(pos, value) of the nearest
    row with a value at or before, at or after the row. Each block works on its own rows; what it
    needs from other blocks comes from a table with one row per block. ``layout`` passes on the
    blocks found earlier for the same rows.
    """
    if isinstance(layout, str):
        layout = block_layout(df, s, 0)
    laid = _place(df, s, layout)
    w = s.window()
    to_here = w.rowsBetween(Window.unboundedPreceding, 0)
    from_here = w.rowsBetween(0, Window.unboundedFollowing)
    fold = {"sum": F.sum, "min": F.min, "max": F.max}
    summary, inside, merge = [], {}, {}
    for name, (kind, column) in wanted.items():
        held = F.when(F.col(column).isNotNull(), F.struct(F.col("_pos").alias("pos"), F.col(column).alias("value")))
        if kind in fold:
            summary.append(fold[kind](column).alias(f"_s_{name}"))
            inside[name] = fold[kind](column).over(to_here)
        elif kind == "last":
            summary.append(F.max(held).alias(f"_s_{name}"))
            inside[name] = F.last(held, ignorenulls=True).over(to_here)
        elif kind == "next":
            summary.append(F.min(held).alias(f"_s_{name}"))
            inside[name] = F.first(held, ignorenulls=True).over(from_here)
        else:
            raise ValueError(f"unknown kind: {kind}")
    per_block = laid.groupBy(*s.keys, "_home").agg(*summary)
    blocks = Window.partitionBy(*s.keys).orderBy("_home")
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    after = blocks.rowsBetween(1, Window.unboundedFollowing)
    carried = []
    for name, (kind, _) in wanted.items():
        part = F.col(f"_s_{name}")
        if kind in fold:
            carried.append(fold[kind](part).over(before).alias(f"_c_{name}"))
            both = {
                "sum": lambda a, b: F.coalesce(a + b, a, b),
                "min": lambda a, b: F.least(a, b),
                "max": lambda a, b: F.greatest(a, b),
            }[kind]
        elif kind == "last":
            carried.append(F.last(part, ignorenulls=True).over(before).alias(f"_c_{name}"))
            both = F.coalesce
        else:
            carried.append(F.first(part, ignorenulls=True).over(after).alias(f"_c_{name}"))
            both = F.coalesce
        merge[name] = (inside[name], both)
    out = laid
    for name, (column, _) in merge.items():
        out = out.withColumn(f"_i_{name}", column)
    if layout is not None:
        carry = settle(per_block.select(*s.keys, "_home", *carried), "carry")
        out = attach(out, carry, [*s.keys, "_home"])
    for name, (_, both) in merge.items():
        here = F.col(f"_i_{name}")
        out = out.withColumn(name, here if layout is None else both(here, F.col(f"_c_{name}")))
    if pos:
        out = out.withColumn("pos", F.col("_pos"))
    helpers = [f"_{x}_{name}" for name in wanted for x in "ic"]
    return out.drop("_home", "_own", "_pos", *helpers)
