"""Exploration: summaries, seasonality, correlation, distributions, trend labels."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import normal_quantile, ratio
from tickloom.operators import indicators, lags
from tickloom.operators.blocks import Series, add_features, attach, numbered
from tickloom.operators.cleaning import IQR_LIMIT, Z_LIMIT, flag_outliers, tail
from tickloom.operators.quantiles import quantiles
from tickloom.sources.session import settle

# Bounds of the labels, in percent, and window lengths, in rows.
BULLISH, BEARISH = 0.1, -0.1
RECENT_ROWS = 7
VOLATILITY_ROWS = 30
BINS = 30

QUARTERS = (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))


def _long(wide: DataFrame, keys: Sequence[str], columns: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``{field}_{column}`` columns to one row per column."""
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"{f}_{c}").alias(f) for f in fields]) for c in columns
    ])
    return wide.select(*keys, F.inline(rows))


def _merge(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two one-row-per-key tables side by side."""
    return attach(left, right, keys)


def describe(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max: one row per key and column."""
    folds = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    base = df.groupBy(*keys).agg(*[fold(c).alias(f"{name}_{c}") for c in columns for name, fold in folds.items()])
    spread = quantiles(df, keys, {f"{name}_{c}": (c, p) for c in columns for name, p in QUARTERS})
    fields = ["count", "mean", "std", "min", *[q for q, _ in QUARTERS], "max"]
    return _long(_merge(base, spread, keys), keys, columns, fields)


def price_stats(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean, sample deviation and coefficient of variation in percent."""
    wide = df.groupBy(*keys).agg(
        *[a for c in columns for a in (F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}"))]
    )
    wide = wide.withColumns({f"cv_pct_{c}": ratio(f"std_{c}", f"mean_{c}") * 100 for c in columns})
    return _long(wide, keys, columns, ["mean", "std", "cv_pct"])


def spread_stats(df: DataFrame, keys: Sequence[str], sell: str = "sell", buy: str = "buy") -> DataFrame:
    gap = lags.spread_columns(sell, buy)
    spread = gap["price_diff"]
    return df.groupBy(*keys).agg(
        F.avg(spread).alias("mean"),
        F.min(spread).alias("min"),
        F.max(spread).alias("max"),
        F.avg(gap["price_spread_pct"]).alias("mean_pct"),
    )


def seasonal(df: DataFrame, keys: Sequence[str], ts: str, value: str, unit: str = "month") -> DataFrame:
    """Mean and sample deviation per month, or per weekday with its name."""
    if unit == "month":
        groups = [F.month(ts).alias("month"), F.date_format(ts, "MMMM").alias("month_name")]
    elif unit == "weekday":
        groups = [F.weekday(ts).alias("weekday"), F.date_format(ts, "EEEE").alias("weekday_name")]
    else:
        raise ValueError(f"unknown unit: {unit}")
    return df.groupBy(*keys, *groups).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def corr_matrix(df: DataFrame, keys: Sequence[str], columns: Sequence[str], triangle: bool = False) -> DataFrame:
    """Correlation of every pair of columns, all in one aggregation: (left, right, corr).

    ``triangle`` keeps each pair once, without the diagonal.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for j, b in enumerate(columns) if i >= j]
    wide = df.groupBy(*keys).agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])

    def cell(a: str, b: str, i: int) -> Column:
        return F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"_{i}").alias("corr"))

    cells = []
    for i, (a, b) in enumerate(pairs):
        if a != b:
            cells.append(cell(a, b, i))
        if not triangle:
            cells.append(cell(b, a, i))
    return wide.select(*keys, F.inline(F.array(*cells)))


def rank_corr(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Columns by absolute correlation with the target, strongest first."""
    names = [c for c in columns if c != target]
    wide = df.agg(*[F.corr(c, target).alias(c) for c in names])
    rows = wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("corr")) for c in names])))
    return rows.withColumn("strength", F.abs("corr")).orderBy(F.desc_nulls_last("strength"), "column")


def outlier_summary(df: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    """Outlier count and share by z-score (population) and by quartile range."""
    by_iqr = flag_outliers(df, keys, [c], "iqr", IQR_LIMIT).withColumnRenamed(f"{c}_outlier", "_iqr")
    both = flag_outliers(by_iqr, keys, [c], "zscore_pop", Z_LIMIT)
    n = F.count(F.lit(1))
    z, q = F.count_if(F.col(f"{c}_outlier")), F.count_if("_iqr")
    return both.groupBy(*keys).agg(
        z.alias("z_count"), (ratio(z, n) * 100).alias("z_pct"), q.alias("iqr_count"), (ratio(q, n) * 100).alias("iqr_pct")
    )


def outlier_rows(df: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    return flag_outliers(df, keys, [c]).where(f"{c}_outlier").drop(f"{c}_outlier")


def return_stats(df: DataFrame, s: Series, c: str) -> DataFrame:
    """Mean and deviation of the daily change in percent, largest gain and loss, trend label."""
    changes = add_features(df, s, lags.price_change(c))
    stats = changes.groupBy(*s.keys).agg(
        F.avg("price_change").alias("mean"),
        F.stddev_samp("price_change").alias("std"),
        F.max("price_change").alias("max_gain"),
        F.min("price_change").alias("max_loss"),
    )
    return stats.withColumn("trend", trend_label(F.col("mean")))


def trend_label(mean_change: Column) -> Column:
    return F.when(mean_change > 0, "Upward").otherwise("Downward")


def most_volatile(df: DataFrame, s: Series, c: str, rows: int = VOLATILITY_ROWS) -> DataFrame:
    """Date of the largest rolling deviation of changes; none for series of ``rows`` rows or fewer."""
    moved = add_features(df, s, indicators.return_volatility(c, rows))
    top = moved.groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.when(F.col("volatility").isNotNull(), F.struct("volatility", (-F.unix_date(F.to_date(s.ts))).alias("d"), s.ts))).alias("_top"),
    )
    return top.where((F.col("_n") > rows) & F.col("_top").isNotNull()).select(
        *s.keys, F.col(f"_top.{s.ts}").alias(s.ts), F.col("_top.volatility").alias("volatility")
    )


def momentum_label(df: DataFrame, s: Series, c: str, rows: int = RECENT_ROWS) -> DataFrame:
    """Mean of the latest changes in percent and its label."""
    recent = tail(df.select(*s.keys, s.ts, *s.tie, c), s, rows + 1)
    changes = add_features(recent, s, lags.price_change(c))
    mean = changes.groupBy(*s.keys).agg(F.avg("price_change").alias("recent_change"))
    label = F.when(F.col("recent_change") > BULLISH, "Bullish").when(F.col("recent_change") < BEARISH, "Bearish")
    return mean.withColumn("momentum", label.otherwise("Neutral"))


def histogram(df: DataFrame, keys: Sequence[str], c: str, bins: int = BINS) -> DataFrame:
    """Equal-width bins between the smallest and largest value; empty bins are listed too."""
    ends = settle(
        df.groupBy(*keys).agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"), F.count(c).alias("_n")), "ends"
    )
    width = F.try_divide(F.col("_hi") - F.col("_lo"), F.lit(bins))
    at = F.floor(F.try_divide(F.col(c) - F.col("_lo"), width))
    # a single distinct value has no width; all of it lies in the first bin
    slot = F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int")
    counted = (
        attach(df.where(F.col(c).isNotNull()).select(*keys, c), ends, keys)
        .groupBy(*keys, slot.alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    every = ends.where("_n > 0").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = attach(every, counted, [*keys, "bin"])
    count = F.coalesce("count", F.lit(0))
    return full.select(
        *keys,
        "bin",
        (F.col("_lo") + width * F.col("bin")).alias("from"),
        (F.col("_lo") + width * (F.col("bin") + 1)).alias("to"),
        count.alias("count"),
        ratio(count, F.col("_n") * width).alias("density"),
    )


def box_stats(df: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    """Quartiles, whiskers at the outermost values within 1.5 quartile ranges, and fliers beyond."""
    quarters = settle(quantiles(df, keys, {name: (c, p) for name, p in QUARTERS}), "quarters")
    reach = (F.col("q75") - F.col("q25")) * IQR_LIMIT
    inside = F.col(c).between(F.col("q25") - reach, F.col("q75") + reach)
    ends = (
        attach(df.select(*keys, c), quarters, keys)
        .groupBy(*keys)
        .agg(
            F.min(F.when(inside, F.col(c))).alias("whisker_low"),
            F.max(F.when(inside, F.col(c))).alias("whisker_high"),
            F.count_if(~inside).alias("fliers"),
        )
    )
    return _merge(quarters, ends, keys)


def qq_points(df: DataFrame, s: Series, c: str) -> DataFrame:
    """Ordered values beside the normal quantiles of their positions (Filliben's estimate)."""
    rows = df.where(F.col(c).isNotNull()).select(*s.keys, s.ts, *s.tie, c)
    ordered = numbered(rows, Series(s.keys, c, (s.ts, *s.tie), s.block_rows))
    i, n = F.col("pos") + 1, F.col("n")
    edge = F.pow(F.lit(0.5), F.try_divide(F.lit(1.0), n))
    place = (
        F.when(i == n, edge).when(i == 1, 1 - edge).otherwise(F.try_divide(i - 0.3175, n + 0.365))
    )
    return ordered.select(*s.keys, F.col("pos").alias("position"), F.col(c).alias("value"), normal_quantile(place).alias("quantile"))


def top_n(df: DataFrame, by: str, n: int = 15, tie: Sequence[str] = ()) -> DataFrame:
    """The n highest rows; each task keeps n before they meet."""
    return df.orderBy(F.desc(by), *tie).limit(n)


def forecast_summary(df: DataFrame, s: Series, value: str) -> DataFrame:
    """Range, mean and average step of a forecast."""
    steps = add_features(df, s, lags.difference(value, "_step"))
    return steps.groupBy(*s.keys).agg(
        F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
        F.avg(value).alias("average"),
        F.avg("_step").alias("average_step"),
    )
