"""Lags, differences, returns and spread columns."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.columns import ratio
from tickloom.operators.blocks import Feature, Series

# Default lag distances and return distances, in rows.
LAGS = (1, 2, 3, 5, 7, 14, 30)
RETURN_STEPS = (1, 3, 7)


def lags(columns: Sequence[str], distances: Sequence[int] = LAGS) -> Feature:
    """``{column}_lag_{k}`` for every column and distance."""

    def build(df: DataFrame, s: Series) -> DataFrame:
        w = s.window()
        return df.withColumns({f"{c}_lag_{k}": F.lag(c, k).over(w) for c in columns for k in distances})

    return Feature(max(distances), build)


def change(c: str, k: int, w: WindowSpec) -> Column:
    """Relative change over k rows; null on a zero base."""
    return ratio(F.col(c), F.lag(c, k).over(w)) - 1


def _changes(c: str, names: dict[str, int], scale: float = 1.0) -> Feature:
    def build(df: DataFrame, s: Series) -> DataFrame:
        w = s.window()
        return df.withColumns({name: change(c, k, w) * scale for name, k in names.items()})

    return Feature(max(names.values()), build)


def momentum(c: str, steps: Sequence[int] = RETURN_STEPS) -> Feature:
    return _changes(c, {f"momentum_{k}": k for k in steps})


def returns(c: str, steps: Sequence[int] = RETURN_STEPS) -> Feature:
    return _changes(c, {f"return_{k}d": k for k in steps})


def price_change(c: str, name: str = "price_change") -> Feature:
    """Change from the previous row in percent."""
    return _changes(c, {name: 1}, 100.0)


def difference(c: str, name: str | None = None) -> Feature:
    def build(df: DataFrame, s: Series) -> DataFrame:
        return df.withColumn(name or f"{c}_diff", F.col(c) - F.lag(c).over(s.window()))

    return Feature(1, build)


def spread_columns(sell: str = "sell", buy: str = "buy") -> dict[str, Column]:
    gap = F.col(sell) - F.col(buy)
    return {
        "price_diff": gap,
        "price_ratio": ratio(sell, buy),
        "price_spread_pct": F.try_divide(gap, F.col(buy)) * 100,
    }


def add_spread(df: DataFrame, sell: str = "sell", buy: str = "buy") -> DataFrame:
    """Spread, ratio and spread in percent of the buy price; no window needed."""
    return df.withColumns(spread_columns(sell, buy))
