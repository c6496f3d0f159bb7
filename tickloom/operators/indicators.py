"""Rolling statistics and technical indicators as features over series blocks."""
from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import ratio
from tickloom.operators import lags
from tickloom.operators.blocks import Feature, Series, attach, rolled, rows_back
from tickloom.sources.session import settle

# Default window lengths, in rows.
AVERAGE_PERIODS = (5, 10, 20, 50)
STAT_PERIODS = (5, 10, 20)
POSITION_PERIODS = (10, 20, 50)
RSI_PERIOD = 14
MACD_SPANS = (12, 26, 9)
BAND_PERIOD = 20
BAND_WIDTH = 2

# The last value of a stretch of rows outweighs by this exponent all that lies a whole stretch further back, beyond what a double holds.
FORGOTTEN = 45.0
# Weights inside a stretch span no more than this exponent.
LARGEST_EXPONENT = 600.0


def _from_rolls(c: str, names: dict[str, tuple[str, int]]) -> Feature:
    """Columns that are rolling aggregates as they are: name -> (fold, rows)."""
    rolls = tuple((c, fold, n) for fold, n in names.values())
    return Feature(
        max(n for _, n in names.values()) - 1,
        lambda df, s: df.withColumns({name: rolled(c, fold, n) for name, (fold, n) in names.items()}),
        rolls,
    )


def sma(c: str, periods: Sequence[int] = AVERAGE_PERIODS) -> Feature:
    return _from_rolls(c, {f"sma_{n}": ("avg", n) for n in periods})


def volatility(c: str, periods: Sequence[int] = STAT_PERIODS) -> Feature:
    return _from_rolls(c, {f"volatility_{n}": ("std", n) for n in periods})


def rolling_stats(c: str, periods: Sequence[int] = STAT_PERIODS) -> Feature:
    kinds = {"mean": "avg", "std": "std", "min": "min", "max": "max"}
    return _from_rolls(c, {f"rolling_{kind}_{n}": (fold, n) for n in periods for kind, fold in kinds.items()})


def price_position(c: str, periods: Sequence[int] = POSITION_PERIODS) -> Feature:
    """Place of the price between the window's low (0) and high (1); null on a flat window."""

    def build(df: DataFrame, s: Series) -> DataFrame:
        out = {}
        for n in periods:
            low, high = rolled(c, "min", n), rolled(c, "max", n)
            out[f"price_position_{n}"] = ratio(F.col(c) - low, high - low)
        return df.withColumns(out)

    return Feature(max(periods) - 1, build, tuple((c, fold, n) for n in periods for fold in ("min", "max")))


def bollinger(c: str, period: int = BAND_PERIOD, width: float = BAND_WIDTH) -> Feature:
    def build(df: DataFrame, s: Series) -> DataFrame:
        middle, reach = rolled(c, "avg", period), rolled(c, "std", period) * width
        upper, lower = middle + reach, middle - reach
        return df.withColumns({"bollinger_upper": upper, "bollinger_lower": lower, "bollinger_width": upper - lower})

    return Feature(period - 1, build, ((c, "avg", period), (c, "std", period)))


def return_volatility(c: str, period: int = 30, name: str = "volatility") -> Feature:
    """Rolling sample deviation of the daily change in percent."""

    def build(df: DataFrame, s: Series) -> DataFrame:
        changes = df.withColumn("_change", lags.change(c, 1, s.window()) * 100)
        frame = rows_back(s, period)
        complete = F.count("_change").over(frame) == period
        return changes.withColumn(name, F.when(complete, F.stddev_samp("_change").over(frame))).drop("_change")

    return Feature(period, build)


def rsi(c: str, period: int = RSI_PERIOD, name: str = "rsi") -> Feature:
    """Simple-mean RSI. The first row's change counts as 0; a window without any move gives null."""

    def build(df: DataFrame, s: Series) -> DataFrame:
        step = F.col(c) - F.lag(c).over(s.window())
        moves = df.withColumns(
            {
                "_gain": F.when(step > 0, step).otherwise(F.lit(0.0)),
                "_loss": F.when(step < 0, -step).otherwise(F.lit(0.0)),
            }
        )
        frame = rows_back(s, period)
        gain, loss = (F.sum(m).over(frame) for m in ("_gain", "_loss"))
        share = F.try_divide(gain * 100, gain + loss)
        enough = F.count(F.lit(1)).over(frame) == period
        return moves.withColumn(name, F.when(enough, share)).drop("_gain", "_loss")

    return Feature(period, build)


def rsi_zone(value: str | Column = "rsi") -> Column:
    """Overbought from 70, oversold to 30, else neutral."""
    value = F.col(value) if isinstance(value, str) else value
    return (
        F.when(value >= 70, "overbought")
        .when(value <= 30, "oversold")
        .when(value >= 50, "neutral_high")
        .when(value < 50, "neutral_low")
    )


def _rate(span: int) -> float:
    """Exponent by which a value's weight falls per row."""
    return -math.log1p(-2.0 / (span + 1))


def _scans(spans: Sequence[int]) -> list[tuple[int, list[int]]]:
    """(rows of a stretch, spans) of each scan: slow spans need long stretches, in which fast ones would leave the range of a double."""
    out: list[tuple[int, list[int]]] = []
    for span in sorted(set(spans), reverse=True):
        if out and _rate(span) * out[-1][0] <= LARGEST_EXPONENT:
            out[-1][1].append(span)
        else:
            out.append((math.ceil(FORGOTTEN / _rate(span)), [span]))
    return out


def _joined(older: Column, gap: Column, rate: float, mean: Column, logw: Column) -> tuple[Column, Column]:
    """Mean and log weight of a decay map after another, whose struct (mean, logw) held ``gap`` rows ago. Null means without values."""
    faded = older["logw"] - gap * rate
    part = F.exp(faded - logw)
    both = logw.isNotNull() & faded.isNotNull()
    return (
        F.when(both, (mean + part * older["mean"]) / (1 + part)).otherwise(F.coalesce(mean, older["mean"])),
        F.when(both, logw + F.log1p(part)).otherwise(F.coalesce(logw, faded)),
    )


def _scan(df: DataFrame, s: Series, wanted: dict[str, tuple[str, float]], rows: int) -> DataFrame:
    """``_m_name`` and ``_l_name``: decayed mean and log weight over the block's own rows so far, name -> (column, rate).

    Row numbers are cut into stretches of ``rows``. Inside a stretch the sums are prefix sums of x q^-j, scaled by q^j. What lies before is
    the last stretch with a value, joined with the one before that; older ones weigh less than a double holds, whatever gaps lie between.
    """
    stretch = Window.partitionBy(*s.keys, "_home", "_stretch").orderBy(*s.order())
    so_far = stretch.rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*s.keys, "_home").orderBy("_stretch", *s.order()).rowsBetween(Window.unboundedPreceding, -1)
    pos, j = F.col("_pos"), F.col("_j")
    df = df.withColumns({"_stretch": F.floor(F.try_divide(pos, F.lit(rows))), "_j": pos % rows})
    sums, own, ends, alone, full, last, out = {}, {}, {}, {}, {}, {}, {}
    for name, (c, rate) in wanted.items():
        x = F.when(F.col("_own"), F.col(c))
        grown = F.exp(j * rate)
        sums[f"_s_{name}"] = F.sum(x * grown).over(so_far)
        sums[f"_w_{name}"] = F.sum(F.when(x.isNotNull(), grown)).over(so_far)
        mean, logw = F.try_divide(F.col(f"_s_{name}"), F.col(f"_w_{name}")), F.ln(f"_w_{name}") - j * rate
        own[f"_m_{name}"], own[f"_l_{name}"] = mean, logw
        mean, logw = F.col(f"_m_{name}"), F.col(f"_l_{name}")
        ends[f"_e_{name}"] = F.when((j == rows - 1) & logw.isNotNull(), F.struct(pos.alias("pos"), mean.alias("mean"), logw.alias("logw")))
        alone[f"_a_{name}"] = F.last(f"_e_{name}", ignorenulls=True).over(earlier)
        before = F.col(f"_a_{name}")
        both = _joined(before, pos - before["pos"], rate, mean, logw)
        full[f"_f_{name}"] = F.when(F.col(f"_e_{name}").isNotNull(), F.struct(pos.alias("pos"), both[0].alias("mean"), both[1].alias("logw")))
        last[f"_b_{name}"] = F.last(f"_f_{name}", ignorenulls=True).over(earlier)
        before = F.col(f"_b_{name}")
        out[f"_m_{name}"], out[f"_l_{name}"] = _joined(before, pos - before["pos"], rate, mean, logw)
    for step in (sums, own, ends, alone, full, last, out):
        df = df.withColumns(step)
    return df.drop("_stretch", "_j", *sums, *ends, *alone, *full, *last)


def _carried(df: DataFrame, s: Series, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """(keys, _home, _c_name): decay maps composed over all blocks before each block, a row for each block of a cut series.

    A block's map is its rows, the mean and the log weight of its values at its end. Weights are taken relative to the block's last
    value, so they hold however long it is ago.
    """
    block = Window.partitionBy(*s.keys, "_home")
    own = df.where("_own")
    own = own.withColumns({f"_p_{n}": F.max(F.when(F.col(c).isNotNull(), F.col("_pos"))).over(block) for n, (c, _) in wanted.items()})
    parts = [F.max("_pos").alias("_end")]
    for name, (c, rate) in wanted.items():
        share = F.when(F.col(c).isNotNull(), F.exp((F.col("_pos") - F.col(f"_p_{name}")) * rate))
        parts += [F.max(f"_p_{name}").alias(f"_p_{name}"), F.sum(F.col(c) * share).alias(f"_s_{name}"), F.sum(share).alias(f"_w_{name}")]
    maps = own.groupBy(*s.keys, "_home").agg(*parts)
    rates = {name: rate for name, (_, rate) in wanted.items()}
    kept = [f.simpleString().split(":", 1) for f in maps.schema if f.name in (*s.keys, "_home")]
    carries = ", ".join([f"`{n}` {t}" for n, t in kept] + [f"_c_{n} struct<pos:long,mean:double,logw:double>" for n in rates])

    def composed(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("_home")
        out = blocks[[n for n, _ in kept]].copy()
        for name, rate in rates.items():
            rows, held = [], None
            for end, at, total, weight in zip(blocks["_end"], blocks[f"_p_{name}"], blocks[f"_s_{name}"], blocks[f"_w_{name}"], strict=True):
                rows.append(held)
                if weight > 0:
                    mean, logw = total / weight, math.log(weight) - rate * (end - at)
                    if held is not None:
                        part = math.exp(held["logw"] - rate * (end - held["pos"]) - logw)
                        mean, logw = (mean + part * held["mean"]) / (1 + part), logw + math.log1p(part)
                    held = {"pos": int(end), "mean": mean, "logw": logw}
            out[f"_c_{name}"] = pd.Series(rows, index=blocks.index, dtype=object)
        return out

    return settle(maps.groupBy(*s.keys).applyInPandas(composed, carries), "decay-maps")


def _ewm(df: DataFrame, s: Series, wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """Adjusted exponential means, name -> (column, span), for any spans and any gaps.

    With q the decay, the mean is sum(q^i x[t-i]) / sum(q^i) over all earlier rows with a value; a row without one keeps the mean. A span of 1 is the last value.
    """
    rates = {name: (c, _rate(span) if span > 1 else LARGEST_EXPONENT) for name, (c, span) in wanted.items()}
    for rows, spans in _scans([span for _, span in wanted.values() if span > 1]):
        df = _scan(df, s, {name: rates[name] for name, (_, span) in wanted.items() if span in spans}, rows)
    lasts = {name: c for name, (c, span) in wanted.items() if span <= 1}
    so_far = s.window().rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"_m_{name}": F.last(F.when(F.col("_own"), F.col(c)), ignorenulls=True).over(so_far) for name, c in lasts.items()})
    if not s.cut:
        return df.withColumns({name: F.col(f"_m_{name}") for name in wanted}).drop(*[f"_{k}_{name}" for name in wanted for k in "ml"])
    df = attach(df, _carried(df, s, rates), [*s.keys, "_home"])
    means = {}
    for name in wanted:
        held = F.col(f"_c_{name}")
        if name in lasts:
            means[name] = F.coalesce(f"_m_{name}", held["mean"])
        else:
            means[name] = _joined(held, F.col("_pos") - held["pos"], rates[name][1], F.col(f"_m_{name}"), F.col(f"_l_{name}"))[0]
    return df.withColumns(means).drop(*[f"_{k}_{name}" for name in wanted for k in "mlc"])


def ema(c: str, spans: Sequence[int] = AVERAGE_PERIODS) -> Feature:
    """Exponential means ``ema_n`` of the given spans, 1 or more."""
    if any(n < 1 for n in spans):
        raise ValueError(f"spans must be 1 or more: {tuple(spans)}")
    return Feature(0, lambda df, s: _ewm(df, s, {f"ema_{n}": (c, n) for n in spans}))


def macd(c: str, spans: tuple[int, int, int] = MACD_SPANS) -> Feature:
    """Fast minus slow mean, its own mean (signal), and the difference (histogram)."""
    fast, slow, signal = spans

    def build(df: DataFrame, s: Series) -> DataFrame:
        df = _ewm(df, s, {"_fast": (c, fast), "_slow": (c, slow)})
        df = df.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
        df = _ewm(df, s, {"macd_signal": ("macd", signal)})
        return df.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))

    return Feature(0, build)


def indicators(c: str, periods: Sequence[int] = AVERAGE_PERIODS) -> tuple[Feature, ...]:
    """The full indicator set."""
    return (
        sma(c, periods),
        ema(c, periods),
        rsi(c),
        macd(c),
        bollinger(c),
        lags.momentum(c),
        volatility(c),
    )


def derived(sell: str = "sell", buy: str = "buy") -> tuple[Feature, ...]:
    """Spread, returns, rolling statistics and price position."""
    return (
        Feature(0, lambda df, s: df.withColumns(lags.spread_columns(sell, buy))),
        lags.returns(sell),
        rolling_stats(sell),
        price_position(sell),
    )
