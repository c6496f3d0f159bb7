"""Linear models on lags, fitted for many series, parameter sets and folds from one pass over the rows.

A least-squares fit needs only sums of products of its inputs and its target, the Gram matrix. These sums are plain aggregates per
series and part of it, combined on the map side. Every parameter set reads its own entries of them, a fold's training part is the sum of the parts before
it, and the error on held-out rows follows from their matrix too. So rows are read once whatever is fitted, and what is solved is a small
system per series.
"""
from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators import lags as lag
from tickloom.operators.blocks import Series, add_features, attach, numbered
from tickloom.operators.sequences import split_by_time
from tickloom.sources.session import settle


def _lagged(df: DataFrame, s: Series, target: str, steps: Sequence[int]) -> DataFrame:
    """Rows with ``_x_k`` (the target k rows ago) and ``_y``, all less the series' mean ``_mean``, which keeps the sums exact."""
    narrow = df.select(*s.keys, s.ts, *s.tie, F.col(target).cast("double").alias("_t"))
    wide = add_features(narrow, s, lag.lags(["_t"], list(steps)))
    means = settle(narrow.groupBy(*s.keys).agg(F.avg("_t").alias("_mean")), "means")
    shifted = {f"_x_{k}": F.col(f"_t_lag_{k}") - F.col("_mean") for k in steps}
    return attach(wide, means, s.keys).withColumns({**shifted, "_y": F.col("_t") - F.col("_mean")})


def _gram(steps: Sequence[int], among: Column) -> Column:
    """Sums of products of (1, lags, target) over rows that have them all, as the upper triangle row by row."""
    terms = [F.lit(1.0), *[F.col(f"_x_{k}") for k in steps], F.col("_y")]
    whole = among
    for t in terms[1:]:
        whole = whole & t.isNotNull()
    return F.array(*[F.coalesce(F.sum(F.when(whole, a * b)), F.lit(0.0)) for i, a in enumerate(terms) for b in terms[i:]])


def _solver(steps: tuple[int, ...]):
    """Functions of Gram matrices; they travel to the workers by value."""
    size = len(steps) + 2
    upper = np.triu_indices(size)

    def matrix(triangle) -> np.ndarray:
        out = np.zeros((size, size))
        out[upper] = np.asarray(triangle, float)
        return out + np.triu(out, 1).T

    def fit(g: np.ndarray, own: Sequence[int], ridge: float) -> np.ndarray | None:
        """Intercept and weights on the lags ``own``; None if there are fewer rows than these."""
        at = [0, *(1 + steps.index(k) for k in own)]
        if g[0, 0] < len(at):
            return None
        a = g[np.ix_(at, at)] + np.diag([0.0] + [ridge] * len(own))
        return np.linalg.lstsq(a, g[at, size - 1], rcond=1e-12)[0]

    def error(g: np.ndarray, own: Sequence[int], w: np.ndarray) -> float | None:
        """Root mean squared error over the rows behind ``g``."""
        at = [0, *(1 + steps.index(k) for k in own)]
        if g[0, 0] < 1:
            return None
        total = g[-1, -1] - 2 * w @ g[at, size - 1] + w @ g[np.ix_(at, at)] @ w
        return float(np.sqrt(max(total, 0.0) / g[0, 0]))

    return matrix, fit, error


def _fields(df: DataFrame, names: Sequence[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name in names)


def linear_search(
    df: DataFrame, s: Series, target: str, sets: Sequence[Mapping], train: float = 0.8, validation: float = 0.1
) -> DataFrame:
    """Fit every parameter set on each series' training part and score it on the validation part.

    A set has ``lags`` (the inputs: the target so many rows ago) and ``ridge`` (penalty on the weights, 0 if not given). Gives (keys, set, lags, ridge,
    n_train, n_valid, intercept, weights, rmse), a row per series and set; all sets see the same rows, those that have every lag of any set.
    Without enough training rows the fit is null, without validation rows its error.
    """
    steps = tuple(sorted({k for p in sets for k in p["lags"]}))
    rows = split_by_time(_lagged(df, s, target, steps), s, train, validation, 1.0 - train - validation)
    parts = {"_fit": "train", "_test": "validation"}
    grams = rows.groupBy(*s.keys).agg(*[_gram(steps, F.col("split") == part).alias(c) for c, part in parts.items()], F.first("_mean").alias("_mean"))
    keys, chosen, (matrix, fit, error) = list(s.keys), [(list(p["lags"]), float(p.get("ridge", 0.0))) for p in sets], _solver(steps)

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.list_(pa.int32()), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.float64())
        names = ["set", "lags", "ridge", "n_train", "n_valid", "intercept", "weights", "rmse"]
        for batch in batches:
            out, own = [], []
            for row, (a, b, mean) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_fit", "_test", "_mean")), strict=True)):
                g, held = matrix(a), matrix(b)
                for i, (inputs, ridge) in enumerate(chosen):
                    w = fit(g, inputs, ridge)
                    start = None if w is None else float(w[0] + mean * (1 - w[1:].sum()))
                    out.append((i, inputs, ridge, int(g[0, 0]), int(held[0, 0]), start, None if w is None else w[1:].tolist(), None if w is None else error(held, inputs, w)))
                    own.append(row)
            keyed = [batch.column(k).take(pa.array(own, pa.int64())) for k in keys]
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([*keyed, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [*keys, *names])

    return grams.mapInArrow(solved, f"{_fields(grams, keys)}`set` int, lags array<int>, ridge double, n_train long, n_valid long, intercept double, weights array<double>, rmse double")


def best_fit(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The set with the least validation error of each series, of equal errors the first; series without an error have none."""
    scored = found.where("rmse is not null")
    rest = [c for c in found.columns if c not in (*keys, "rmse", "set")]
    return scored.groupBy(*keys).agg(F.min(F.struct("rmse", "set", *rest)).alias("_b")).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in ("set", *rest, "rmse")])


def _segmented(rows: DataFrame, s: Series, folds: int) -> DataFrame:
    """Add ``fold``: 0 before the first test block, then the number of the block; blocks have n // (folds + 1) rows and end at the last row."""
    placed = numbered(rows, s)
    size = F.floor(F.try_divide("n", F.lit(folds + 1)))
    behind = F.col("pos") - (F.col("n") - size * folds)
    return placed.where(size > 0).withColumn("fold", F.when(behind < 0, 0).otherwise(F.floor(F.try_divide(behind, size)) + 1).cast("int")).drop("pos", "n")


def linear_backtest(df: DataFrame, s: Series, target: str, lags: Sequence[int] = (1,), folds: int = 5, ridge: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Expanding backtest of a linear model that is fitted anew for every fold.

    Gives the fits (keys, fold, n_train, intercept, weights) and the forecasts of the test rows (keys, ts, fold, y_true, y_pred), ready for ``fold_metrics``.
    A fold trains on all rows before its test block that have every lag; series of fewer than folds + 1 rows are left out, test rows
    without a lag or a fit get no forecast.
    """
    steps = tuple(sorted(set(lags)))
    rows = _segmented(_lagged(df, s, target, steps), s, folds)
    pieces = rows.groupBy(*s.keys, "fold").agg(_gram(steps, F.lit(True)).alias("_g"), F.first("_mean").alias("_mean"))
    # folds + 1 matrices a series
    grams = pieces.groupBy(*s.keys).agg(F.sort_array(F.collect_list(F.struct("fold", "_g"))).alias("_gs"), F.first("_mean").alias("_mean"))
    keys, (matrix, fit, _) = list(s.keys), _solver(steps)

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
        for batch in batches:
            out, own = [], []
            for row, (parts, mean) in enumerate(zip(batch.column("_gs").to_pylist(), batch.column("_mean").to_pylist(), strict=True)):
                before = matrix(parts[0]["_g"]) * 0
                for part in parts:
                    if part["fold"]:
                        w = fit(before, steps, ridge)
                        out.append((part["fold"], int(before[0, 0]), None if w is None else float(w[0] + mean * (1 - w[1:].sum())), None if w is None else w[1:].tolist()))
                        own.append(row)
                    before = before + matrix(part["_g"])
            keyed = [batch.column(k).take(pa.array(own, pa.int64())) for k in keys]
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([*keyed, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [*keys, "fold", "n_train", "intercept", "weights"])

    fits = settle(grams.mapInArrow(solved, f"{_fields(grams, keys)}fold int, n_train long, intercept double, weights array<double>"), "fold-fits")
    tested = attach(rows.where("fold > 0"), fits.select(*keys, "fold", "intercept", "weights"), [*keys, "fold"])
    ahead = F.col("intercept")
    for i, k in enumerate(steps):
        ahead = ahead + F.col("weights")[i] * F.col(f"_t_lag_{k}")
    return fits, tested.select(*keys, s.ts, *s.tie, "fold", F.col("_t").alias("y_true"), ahead.alias("y_pred"))
