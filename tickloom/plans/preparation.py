"""The whole preparation of quotes for training, and the same for new data."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tickloom.functions.calendar import add_calendar
from tickloom.operators import cleaning, indicators, lags, quality, scaling, sequences
from tickloom.operators.blocks import Series, add_features
from tickloom.sources.session import settle


@dataclass(frozen=True)
class Preparation:
    """Settings. ``fit_on`` is ``train`` (no leakage) or ``all``."""

    series: Series
    sell: str = "sell"
    buy: str = "buy"
    scaler: str = "minmax"
    length: int = 60
    horizon: int = 1
    stride: int = 1
    shares: tuple[float, float, float] = (0.8, 0.1, 0.1)
    fit_on: str = "train"
    strict: bool = False


@dataclass(frozen=True)
class Prepared:
    features: DataFrame
    sequences: DataFrame
    scaler: scaling.Scaler
    columns: tuple[str, ...]


def featured(df: DataFrame, p: Preparation) -> DataFrame:
    """Calendar, lags, indicators and derived columns; one shuffle for all of them."""
    dated = add_calendar(df, p.series.ts)
    wide = add_features(
        dated,
        p.series,
        lags.lags([p.sell, p.buy]),
        *indicators.indicators(p.sell),
        *indicators.derived(p.sell, p.buy),
    )
    return cleaning.drop_incomplete(wide)


def preprocess(raw: DataFrame, p: Preparation) -> Prepared:
    """Validate, clean, add features, split by time, scale, cut into sequences."""
    prices = [p.sell, p.buy]
    quality.require_valid(raw, prices, p.series.ts, p.series.keys, p.strict)
    # the split, the scaler and the sequences all read the features, so they are written once
    wide = settle(featured(cleaning.clean(raw, p.series, prices), p), "features")
    if wide.isEmpty():
        raise ValueError("no rows left after dropping rows with missing values")
    split = sequences.split_by_time(wide, p.series, *p.shares)
    columns = tuple(scaling.scalable_columns(split, p.series.ts, p.series.keys + p.series.tie))
    fit_rows = split if p.fit_on == "all" else split.where("split = 'train'")
    scaler = scaling.fit_scaler(fit_rows, columns, p.scaler, p.series.keys)
    scaled = scaler.transform(split)
    windows = sequences.make_sequences(scaled, p.series, columns, p.sell, p.length, p.horizon, p.stride)
    return Prepared(scaled, windows, scaler, columns)


def transform_new(df: DataFrame, p: Preparation, scaler: scaling.Scaler) -> DataFrame:
    """New rows through the same features and the fitted scaler: nothing removed as duplicate, nothing refitted."""
    typed = cleaning.parse_types(df, p.series.ts, [p.sell, p.buy])
    filled = cleaning.fill(typed, p.series, [p.sell, p.buy], "forward_fill")
    return scaler.transform(featured(filled, p))
