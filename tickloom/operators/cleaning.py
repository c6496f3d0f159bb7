"""Typing, deduplication, gap filling and outlier treatment of quote tables."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import no_nan
from tickloom.operators.blocks import Layout, Series, attach, block_layout, running
from tickloom.operators.quality import as_number, as_time
from tickloom.operators.quantiles import quantiles
from tickloom.sources.session import settle

# Default outlier limits.
IQR_LIMIT = 1.5
Z_LIMIT = 3.0
CONTAMINATION = 0.1


def parse_types(df: DataFrame, ts: str, prices: Sequence[str]) -> DataFrame:
    """Dates and prices from text; what cannot be read becomes null."""
    out = df.withColumns({ts: as_time(ts), **{c: as_number(c) for c in prices}})
    return no_nan(out)


def dedup_last(df: DataFrame, s: Series) -> DataFrame:
    """Keep, per series and time, the row that is last by the tie columns.

    An aggregate rather than a window: copies of one row meet already on the map side.
    """
    rest = [c for c in df.columns if c not in (*s.keys, s.ts)]
    rank = F.struct(*s.tie, *[c for c in rest if c not in s.tie])
    return (
        df.groupBy(*s.keys, s.ts)
        .agg(F.max(F.struct(rank.alias("rank"), F.struct(*rest).alias("row"))).alias("_top"))
        .select(*[F.col(f"_top.row.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])
    )


def _interpolated(c: str) -> Column:
    before, after, x = F.col(f"_b_{c}"), F.col(f"_a_{c}"), F.col(c)
    share = F.try_divide(F.col("pos") - before["pos"], after["pos"] - before["pos"])
    return F.coalesce(x, before["value"] + (after["value"] - before["value"]) * share, before["value"])


def fill(
    df: DataFrame,
    s: Series,
    columns: Sequence[str],
    strategy: str = "forward_fill",
    layout: Layout | None | str = "find",
) -> DataFrame:
    """Fill nulls per series.

    ``interpolate`` is linear by row position: a leading gap stays, a trailing gap repeats the
    last value. ``drop`` removes rows with a null in any of the columns.
    """
    if strategy == "drop":
        return df.dropna(subset=list(columns))
    if strategy == "mean":
        means = settle(df.groupBy(*s.keys).agg(*[F.avg(c).alias(f"_f_{c}") for c in columns]), "means")
    elif strategy == "median":
        means = quantiles(df, s.keys, {f"_f_{c}": (c, 0.5) for c in columns})
    else:
        return _fill_in_order(df, s, columns, strategy, layout)
    filled = attach(df, means, s.keys).withColumns({c: F.coalesce(c, f"_f_{c}") for c in columns})
    return filled.select(*df.columns)


def _fill_in_order(df: DataFrame, s: Series, columns: Sequence[str], strategy: str, layout) -> DataFrame:
    before = {f"_b_{c}": ("last", c) for c in columns}
    after = {f"_a_{c}": ("next", c) for c in columns}
    if strategy == "forward_fill":
        near = running(df, s, before, layout=layout)
        filled = {c: F.coalesce(c, f"_b_{c}.value") for c in columns}
    elif strategy == "backward_fill":
        near = running(df, s, after, layout=layout)
        filled = {c: F.coalesce(c, f"_a_{c}.value") for c in columns}
    elif strategy == "interpolate":
        near = running(df, s, {**before, **after}, pos=True, layout=layout)
        filled = {c: _interpolated(c) for c in columns}
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    return near.withColumns(filled).select(*df.columns)


def flag_outliers(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    method: str = "iqr",
    threshold: float | None = None,
    approx: bool = False,
) -> DataFrame:
    """Add ``{column}_outlier`` (false on nulls), judged within each series."""
    if method == "iqr":
        limit = IQR_LIMIT if threshold is None else threshold
        wanted = {f"_q{i}_{c}": (c, p) for c in columns for i, p in ((1, 0.25), (3, 0.75))}
        stats = quantiles(df, keys, wanted, approx=approx)

        def test(c: str) -> Column:
            q1, q3, x = F.col(f"_q1_{c}"), F.col(f"_q3_{c}"), F.col(c)
            return (x < q1 - (q3 - q1) * limit) | (x > q3 + (q3 - q1) * limit)

    elif method in ("zscore", "zscore_pop"):
        limit = Z_LIMIT if threshold is None else threshold
        deviation = F.stddev_samp if method == "zscore" else F.stddev_pop
        moments = [a for c in columns for a in (F.avg(c).alias(f"_m_{c}"), deviation(c).alias(f"_d_{c}"))]
        stats = settle(df.groupBy(*keys).agg(*moments), "moments")

        def test(c: str) -> Column:
            return F.abs(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_d_{c}"))) > limit

    elif method == "isolation_forest":
        return _isolation_flags(df, columns, CONTAMINATION if threshold is None else threshold)
    else:
        raise ValueError(f"unknown method: {method}")
    flagged = attach(df, stats, keys).withColumns(
        {f"{c}_outlier": F.coalesce(test(c), F.lit(False)) for c in columns}
    )
    return flagged.select(*df.columns, *[f"{c}_outlier" for c in columns])


TREES, TREE_ROWS, FOREST_SEED = 100, 256, 42


def _path_lengths(sample: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """One isolation tree over one column: split points and the path length of each interval."""
    cap = int(np.ceil(np.log2(max(len(sample), 2))))

    def rest(n: int) -> float:
        return 0.0 if n <= 1 else 2.0 * (np.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n if n > 2 else 1.0

    cuts, depths, todo = [], [], [(np.sort(sample), 0)]
    while todo:
        part, depth = todo.pop()
        if len(part) <= 1 or depth >= cap or part[0] == part[-1]:
            depths.append(depth + rest(len(part)))
            continue
        cut = rng.uniform(part[0], part[-1])
        cuts.append(cut)
        at = np.searchsorted(part, cut, side="right")
        todo += [(part[at:], depth + 1), (part[:at], depth + 1)]
    return np.sort(np.array(cuts)), np.array(depths)


def _isolation_flags(df: DataFrame, columns: Sequence[str], contamination: float) -> DataFrame:
    """Isolation forest per column over the whole table.

    The forest grows from a sample of fixed size (100 trees x 256 values, picked by a hash of the whole row), so what
    is broadcast does not grow with the data; every row is scored where it lies.
    """
    spark = df.sparkSession
    out = df
    for c in columns:
        picked = (
            df.where(F.col(c).isNotNull())
            .select(F.col(c).cast("double").alias("v"), F.xxhash64(F.lit(FOREST_SEED), *df.columns).alias("_at"))
            .orderBy("_at", "v")
            .limit(TREES * TREE_ROWS)
            .toPandas()["v"]
            .to_numpy()
        )
        rng = np.random.default_rng(FOREST_SEED)
        size = min(TREE_ROWS, len(picked))
        forest = [_path_lengths(rng.choice(picked, size, replace=False), rng) for _ in range(TREES)] if size else []
        held = spark.sparkContext.broadcast(forest)

        @F.pandas_udf("double")
        def mean_path(v: pd.Series) -> pd.Series:
            x = v.to_numpy()
            total = np.zeros(len(x))
            for cuts, depths in held.value:
                total += depths[np.searchsorted(cuts, x, side="left")]
            return pd.Series(total / max(len(held.value), 1))

        out = out.withColumn(f"_path_{c}", F.when(F.col(c).isNotNull(), mean_path(F.col(c).cast("double"))))
    bounds = quantiles(out, [], {f"_cut_{c}": (f"_path_{c}", contamination) for c in columns})
    flagged = attach(out, bounds, []).withColumns(
        {f"{c}_outlier": F.coalesce(F.col(f"_path_{c}") < F.col(f"_cut_{c}"), F.lit(False)) for c in columns}
    )
    return flagged.select(*df.columns, *[f"{c}_outlier" for c in columns])


def replace_outliers(
    df: DataFrame,
    s: Series,
    columns: Sequence[str],
    method: str = "iqr",
    threshold: float | None = None,
    layout: Layout | None | str = "find",
) -> DataFrame:
    """Outliers become gaps, and gaps are interpolated."""
    flagged = flag_outliers(df, s.keys, columns, method, threshold)
    blanked = flagged.withColumns({c: F.when(~F.col(f"{c}_outlier"), F.col(c)) for c in columns})
    if isinstance(layout, str):
        layout = block_layout(df, s, 0)
    return fill(blanked.select(*df.columns), s, columns, "interpolate", layout)


def clean(
    df: DataFrame,
    s: Series,
    columns: Sequence[str],
    missing: str = "forward_fill",
    method: str = "iqr",
    threshold: float | None = None,
    drop_nonpositive: bool = False,
) -> DataFrame:
    """Types, duplicates, gaps, outliers.

    A row without a readable date has no place in its series and is left out here;
    ``validate`` reports it. ``drop_nonpositive`` treats prices of 0 or less as missing.

    Several passes read the deduplicated and the filled rows, so both are written once; the blocks
    found for the first serve the second, whose rows are the same.
    """
    typed = parse_types(df, s.ts, columns).where(F.col(s.ts).isNotNull())
    if drop_nonpositive:
        typed = typed.withColumns({c: F.when(F.col(c) > 0, F.col(c)) for c in columns})
    unique = settle(dedup_last(typed, s), "unique")
    layout = block_layout(unique, s, 0) if missing != "drop" else "find"
    filled = settle(fill(unique, s, columns, missing, layout), "filled")
    return replace_outliers(filled, s, columns, method, threshold, layout)


def drop_incomplete(df: DataFrame, check: bool = False) -> DataFrame:
    """Rows with every column present; ``check`` raises when none is left."""
    out = df.dropna("any")
    if check and out.isEmpty():
        raise ValueError("no rows left after dropping rows with missing values")
    return out


def tail(df: DataFrame, s: Series, n: int) -> DataFrame:
    """The last n rows of each series; tasks keep n rows per series before the shuffle."""
    latest = Window.partitionBy(*s.keys).orderBy(*[F.col(c).desc() for c in (s.ts, *s.tie)])
    if not s.keys:
        return df.orderBy(*[F.col(c).desc() for c in (s.ts, *s.tie)]).limit(n)
    return df.withColumn("_back", F.row_number().over(latest)).where(F.col("_back") <= n).drop("_back")
