"""Forecast metrics over rows (keys, ts, y_true, y_pred)."""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import ratio
from tickloom.operators.blocks import Feature, Series, add_features, attach
from tickloom.operators.quantiles import quantiles
from tickloom.sources.session import settle

# Loss parameters, and metrics by direction of better.
HUBER_DELTA = 1.0
PINBALL_LEVELS = (0.1, 0.5, 0.9)
DIRECTION_WEIGHT = 0.5
LOWER_IS_BETTER = ("mape", "rmse", "mae")
HIGHER_IS_BETTER = ("r2", "direction_accuracy")
BOOTSTRAP_SAMPLES = 1000
CONFIDENCE = 0.95

Y, P = "y_true", "y_pred"


def _steps(df: DataFrame, s: Series) -> DataFrame:
    w = s.window()
    true_step = F.col(Y) - F.lag(Y).over(w)
    pred_step = F.col(P) - F.lag(P).over(w)
    return df.withColumns(
        {"_step": true_step, "_hit": (F.signum(true_step) == F.signum(pred_step)).cast("double")}
    )


STEPS = Feature(1, _steps)


def pinball(error: Column, level: float) -> Column:
    return F.greatest(error * level, error * (level - 1))


def huber(error: Column, delta: float = HUBER_DELTA) -> Column:
    size = F.abs(error)
    return F.when(size <= delta, error * error * 0.5).otherwise(size * delta - delta * delta / 2)


def _aggregates() -> dict[str, Column]:
    y, p = F.col(Y), F.col(P)
    e = y - p
    size, scale = F.abs(e), F.abs(y) + F.abs(p)
    return {
        "n": F.count(e),
        "mse": F.avg(e * e),
        "mae": F.avg(size),
        "mape": F.avg(F.abs(F.try_divide(e, y))) * 100,
        "smape": F.avg(F.try_divide(size * 2, scale)) * 100,
        "direction_accuracy": F.coalesce(F.avg("_hit") * 100, F.lit(0.0)),
        "residual_mean": F.avg(e),
        "residual_std": F.stddev_pop(e),
        "residual_min": F.min(e),
        "residual_max": F.max(e),
        "max_error": F.max(size),
        "huber_loss": F.avg(huber(e)),
        **{f"pinball_{round(q * 100)}": F.avg(pinball(e, q)) for q in PINBALL_LEVELS},
        "target_mean": F.avg(y),
        "target_std": F.stddev_pop(y),
        "target_min": F.min(y),
        "target_max": F.max(y),
        "prediction_mean": F.avg(p),
        "prediction_std": F.stddev_pop(p),
        "_var_y": F.var_pop(y),
        "_var_e": F.var_pop(e),
        "_naive": F.avg(F.col("_step") * F.col("_step")),
        "_hit_share": F.avg("_hit"),
    }


def metrics(df: DataFrame, s: Series, median: bool = True) -> DataFrame:
    """All metrics, one row per series: one aggregation over errors and steps.

    ``median`` adds the median absolute error, which needs the quantile passes. Undefined values
    are null: MAPE without a nonzero truth, Theil's U without a change in the truth.
    """
    rows = df.select(*s.keys, s.ts, *s.tie, Y, P)
    stepped = add_features(rows, s, STEPS)
    out = stepped.groupBy(*s.keys).agg(*[c.alias(name) for name, c in _aggregates().items()])
    var_y = F.col("_var_y")
    flat = F.when(F.col("mse") == 0, 1.0).otherwise(0.0)
    rmse = F.sqrt("mse")
    out = out.withColumns(
        {
            "rmse": rmse,
            "r2": F.when(var_y == 0, flat).otherwise(1 - ratio("mse", "_var_y")),
            "explained_variance": F.when(var_y == 0, 0.0).otherwise(1 - ratio("_var_e", "_var_y")),
            "relative_rmse": ratio(rmse, "target_mean") * 100,
            "relative_mae": ratio("mae", "target_mean") * 100,
            "theil_u": ratio(rmse, F.sqrt("_naive")),
            "directional_loss": F.col("mse") * (1 - DIRECTION_WEIGHT) + (1 - F.col("_hit_share")) * DIRECTION_WEIGHT,
        }
    ).drop("_var_y", "_var_e", "_naive", "_hit_share")
    if not median:
        return out
    sized = rows.select(*s.keys, F.abs(F.col(Y) - F.col(P)).alias("_size"))
    return attach(out, quantiles(sized, s.keys, {"median_absolute_error": ("_size", 0.5)}), s.keys)


# Poisson(1) weights from 32 random bits: share of draws below k, as 8 hex digits.
def _poisson_bounds() -> list[str]:
    bounds, total, term = [], 0.0, math.exp(-1.0)
    for k in range(1, 13):
        total += term
        term /= k
        bounds.append(f"{min(int(total * 2**32), 2**32 - 1):08x}")
    return bounds


POISSON_BOUNDS = _poisson_bounds()
DRAWS_PER_HASH = 4


#: Sums of a replicate: weights, values, their squares, squared, absolute and relative errors, direction hits.
WEIGHTED = ("_n", "_sy", "_syy", "_see", "_sae", "_npe", "_spe", "_nhit", "_shit")
#: Rows whose weights a task holds at once, and series whose sums it holds.
WEIGHT_ROWS = 1024
HELD_SERIES = 128


def _weighted_sums(keys: list[str], samples: int):
    bounds = np.array([int(x, 16) for x in POISSON_BOUNDS], np.uint32)
    hashes = -(-samples // DRAWS_PER_HASH)
    tails = [str(g).encode() for g in range(hashes)]
    rows_at_once, held_series, names = WEIGHT_ROWS, HELD_SERIES, WEIGHTED

    def weights(who: list[str]) -> np.ndarray:
        out = []
        for row in who:
            start = hashlib.md5(f"{row}|".encode(), usedforsecurity=False)
            for tail in tails:
                h = start.copy()
                h.update(tail)
                out.append(h.digest())
        drawn = np.frombuffer(b"".join(out), ">u4").reshape(len(who), -1)[:, :samples]
        return np.searchsorted(bounds, drawn, side="right").astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        schema = None

        def passed_on() -> Iterator[pa.RecordBatch]:
            for own, sums in held.items():
                columns = [pa.array([value] * samples, schema.field(k).type) for k, value in zip(keys, own, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(samples, dtype=np.int32)), *(pa.array(sums[:, i]) for i in range(len(names)))], [*keys, "_b", *names])
            held.clear()

        for whole in batches:
            schema = whole.schema
            for first in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(first, rows_at_once)
                y, ee, ae, pe, hit = (batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("_y", "_ee", "_ae", "_pe", "_hit"))
                there = ~np.isnan(ee)
                y, ee, ae = (np.where(there, x, 0.0) for x in (y, ee, ae))
                values = np.column_stack([there, y, y * y, ee, ae, ~np.isnan(pe), np.nan_to_num(pe), ~np.isnan(hit), np.nan_to_num(hit)]).astype(np.float64)
                drawn = weights(batch.column("_who").to_pylist())
                members: dict[tuple, list[int]] = {}
                for i, own in enumerate(zip(*(batch.column(k).to_pylist() for k in keys), strict=True) if keys else [()] * batch.num_rows):
                    members.setdefault(own, []).append(i)
                for own, at in members.items():
                    sums = drawn[at].T @ values[at]
                    held[own] = held[own] + sums if own in held else sums
                    if len(held) >= held_series:
                        yield from passed_on()
        yield from passed_on()

    return run


def bootstrap(
    df: DataFrame, s: Series, samples: int = BOOTSTRAP_SAMPLES, confidence: float = CONFIDENCE, seed: int = 42
) -> DataFrame:
    """Bootstrap intervals of rmse, mae, mape, r2 and direction accuracy: (keys, metric, ...).

    Each row enters replicate b with a Poisson(1) weight taken from a hash of its identity, so
    replicates need no row exchange: a task multiplies the matrix of its rows' weights with their values, and only
    a row of sums per (task, series, replicate) is shuffled. Weights stop at 12, which leaves out a share of 6e-11 of the draws.
    Direction is resampled by pairs of neighbouring rows. Rows with a null value or forecast are in no sum.
    """
    keys = list(s.keys)
    stepped = add_features(df.select(*keys, s.ts, *s.tie, Y, P), s, STEPS)
    means = settle(df.groupBy(*keys).agg(F.avg(Y).alias("_mean")), "means")
    y, e = F.col(Y), F.col(Y) - F.col(P)
    values = attach(stepped, means, keys).select(
        *keys,
        F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in (*keys, s.ts, *s.tie)]).alias("_who"),
        (y - F.col("_mean")).alias("_y"),
        (e * e).alias("_ee"),
        F.abs(e).alias("_ae"),
        F.abs(F.try_divide(e, y)).alias("_pe"),
        F.col("_hit"),
    )
    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in values.schema if f.name in keys], "_b int", *[f"{c} double" for c in WEIGHTED]])
    # a row's weights cost far more than its move, so few rows still use all tasks
    values = values.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_who")
    sums = values.mapInArrow(_weighted_sums(keys, samples), fields).groupBy(*keys, "_b").agg(*[F.sum(c).alias(c) for c in WEIGHTED])
    n = F.when(F.col("_n") > 0, F.col("_n"))
    mean_y, mse = ratio("_sy", n), ratio("_see", n)
    var_y = ratio("_syy", n) - mean_y * mean_y
    replicas = sums.select(
        *keys,
        F.sqrt(mse).alias("rmse"),
        ratio("_sae", n).alias("mae"),
        (ratio("_spe", F.when(F.col("_npe") > 0, F.col("_npe"))) * 100).alias("mape"),
        (1 - ratio(mse, var_y)).alias("r2"),
        (ratio("_shit", F.when(F.col("_nhit") > 0, F.col("_nhit"))) * 100).alias("direction_accuracy"),
    )
    names = ("rmse", "mae", "mape", "r2", "direction_accuracy")
    long = replicas.select(
        *keys, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in names]))
    )
    tail = (1 - confidence) / 2
    # at most `samples` values per group, so the plain percentile is bounded
    return long.groupBy(*keys, "metric").agg(
        F.percentile("v", tail).alias("lower"),
        F.percentile("v", 1 - tail).alias("upper"),
        F.avg("v").alias("mean"),
        F.stddev_pop("v").alias("std"),
    )


def fold_summary(per_fold: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Mean, population deviation, min and max of each metric over the folds."""
    long = per_fold.select(
        *keys, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in names]))
    )
    return long.groupBy(*keys, "metric").agg(
        F.avg("v").alias("mean"),
        F.stddev_pop("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.count("v").alias("n_folds"),
    )


def fold_metrics(df: DataFrame, s: Series, fold: str = "fold") -> DataFrame:
    """Metrics per series and fold."""
    return metrics(df, Series((*s.keys, fold), s.ts, s.tie, s.block_rows), median=False)


def pooled_metrics(df: DataFrame, s: Series, fold: str = "fold") -> DataFrame:
    """Metrics over the forecasts of all folds, put one after the other."""
    lined = df.select(*s.keys, s.ts, *s.tie, fold, Y, P)
    return metrics(lined, Series(s.keys, fold, (s.ts, *s.tie), s.block_rows), median=False)


def compare_models(scores: DataFrame, keys: Sequence[str] = (), model: str = "model") -> DataFrame:
    """Best and worst model per metric; ties go to the first name."""
    names = [m for m in (*LOWER_IS_BETTER, *HIGHER_IS_BETTER) if m in scores.columns]
    rows = F.array(*[
        F.struct(
            F.lit(m).alias("metric"),
            (F.col(m) if m in LOWER_IS_BETTER else -F.col(m)).alias("rank"),
            F.col(model).alias("model"),
        )
        for m in names
    ])
    long = scores.select(*keys, F.inline(rows)).where("rank is not null")
    return long.groupBy(*keys, "metric").agg(
        F.min(F.struct("rank", "model"))["model"].alias("best_model"),
        F.min(F.struct((-F.col("rank")).alias("rank"), "model"))["model"].alias("worst_model"),
    )


def comparison_table(scores: DataFrame, model: str = "model", keys: Sequence[str] = ()) -> DataFrame:
    """Models by MAPE, best first."""
    return scores.select(*keys, model, "mape", "rmse", "mae", "r2", "direction_accuracy").orderBy(
        F.asc_nulls_last("mape"), *keys, model
    )
