"""Training windows, chronological splits and backtest folds."""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.blocks import Series, numbered, own_rows, with_blocks


def make_sequences(
    df: DataFrame, s: Series, features: Sequence[str], target: str, length: int = 60, horizon: int = 1, stride: int = 1
) -> DataFrame:
    """One row per window of ``length`` rows: features as an array of structs, then the target(s).

    The window is anchored at its last feature row (``ts``); targets are the ``horizon`` rows after
    it, a single value when horizon is 1. ``stride`` keeps every n-th window: the data
    grows by length / stride. Windows look back from their last target row, so block copies suffice.
    """
    narrow = df.select(*dict.fromkeys([*s.keys, s.ts, *s.tie, *features, target]))
    laid = with_blocks(narrow, s, length + horizon - 1)
    w = s.window()
    seen = w.rowsBetween(-(length + horizon - 1), -horizon)
    ahead = w.rowsBetween(-(horizon - 1), 0)
    row = F.struct(*[F.col(c).alias(c) for c in features])
    y = F.col(target) if horizon == 1 else F.collect_list(F.struct(F.col(target))).over(ahead)
    made = laid.withColumns(
        {
            "_window": F.collect_list(row).over(seen),
            "_y": y,
            "_anchor": F.lag(s.ts, horizon).over(w),
            "_start": F.col("_pos") - (length + horizon - 1),
        }
    ).where((F.col("_start") >= 0) & (F.col("_start") % stride == 0))
    made = own_rows(made.withColumn("start", F.col("_start")))
    value = F.col("_y") if horizon == 1 else F.transform("_y", lambda x: x[target])
    return made.select(*s.keys, "start", F.col("_anchor").alias(s.ts), F.col("_window").alias("features"), value.alias("target"))


def split_by_time(
    df: DataFrame, s: Series, train: float = 0.8, validation: float = 0.1, test: float = 0.1
) -> DataFrame:
    """Add ``split`` by position within the series; cut points are truncated to whole rows."""
    if not math.isclose(train + validation + test, 1.0, abs_tol=1e-6):
        raise ValueError("split shares must add up to 1")
    placed = numbered(df, s)
    first = F.floor(F.col("n") * train)
    second = F.floor(F.col("n") * (train + validation))
    label = F.when(F.col("pos") < first, "train").when(F.col("pos") < second, "validation").otherwise("test")
    return placed.withColumn("split", label).drop("pos", "n")


def ts_folds(df: DataFrame, s: Series, k: int = 5) -> DataFrame:
    """Expanding folds: add ``fold`` (1..k) and ``part``; a row appears once per fold that uses it.

    Test blocks have n // (k + 1) rows and end at the last row; training is all before them.
    """
    size = F.floor(F.try_divide("n", F.lit(k + 1)))
    placed = numbered(df, s).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    start = F.col("n") - (F.lit(k + 1) - F.col("fold")) * size
    part = F.when(F.col("pos") < start, "train").when(F.col("pos") < start + size, "test")
    return placed.withColumn("part", part).where("part is not null").drop("pos", "n")


def kfold(df: DataFrame, identity: Sequence[str | Column], k: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` (1..k) from a hash of the identifying columns: shuffled, near equal, repeatable."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in identity])
    share = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("fold", (F.pmod(share, F.lit(k)) + 1).cast("int"))


def walk_forward(df: DataFrame, s: Series, window: int, step: int, horizon: int) -> DataFrame:
    """Rolling folds: training [start - window, start), test [start, start + horizon).

    Starts run from ``window`` in steps while start + horizon < n (strictly). A row's folds follow
    from its position, so each row is multiplied only by the folds that contain it.
    """
    placed = numbered(df, s)
    pos, n = F.col("pos"), F.col("n")
    last = F.floor(F.try_divide(n - horizon - 1 - window, F.lit(step)))
    # folds f (from 0) with start = window + f * step that hold this row
    low = F.ceil(F.try_divide(pos - (window + horizon) + 1, F.lit(step)))
    high = F.floor(F.try_divide(pos, F.lit(step)))
    low, high = F.greatest(low, F.lit(0)), F.least(high, last)
    some = placed.where(high >= low).withColumn("fold", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    start = F.lit(window) + F.col("fold") * step
    part = F.when((pos >= start - window) & (pos < start), "train").when((pos >= start) & (pos < start + horizon), "test")
    return (
        some.withColumn("part", part)
        .withColumn("fold", F.col("fold") + 1)
        .where("part is not null")
        .drop("pos", "n")
    )


Forecaster = Callable[[DataFrame, DataFrame], DataFrame]


def backtest(folds: DataFrame, forecaster: Forecaster) -> DataFrame:
    """Forecast all folds in one job: the forecaster gets training and test rows, both with ``fold``."""
    return forecaster(folds.where("part = 'train'").drop("part"), folds.where("part = 'test'").drop("part"))
