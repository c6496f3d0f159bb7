"""Forecasts over many series, and what is derived from them: intervals, scenarios, signals."""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import ratio
from tickloom.operators.blocks import Feature, Series, add_features, attach, numbered
from tickloom.operators.cleaning import tail
from tickloom.operators.quality import validate_requests
from tickloom.operators.quantiles import quantiles
from tickloom.sources.session import settle

# Band of the naive forecast, interval levels, and bounds of signals, context and risk.
NAIVE_BAND = 0.02
LEVELS = (0.80, 0.90, 0.95)
SIGNAL_PCT = 2.0
CONTEXT_PCT = 1.0
RISK_HIGH, RISK_MEDIUM = 0.05, 0.02


def _daily(last: Column, step: Column, kind) -> Column:
    return (last + F.make_dt_interval(step)).cast(kind)


def naive_forecast(df: DataFrame, s: Series, value: str, steps: int, band: float = NAIVE_BAND) -> DataFrame:
    """The last value repeated for ``steps`` days, with a band around it."""
    last = df.groupBy(*s.keys).agg(
        F.max(s.ts).alias("_ts"), F.max(F.struct(s.ts, *s.tie, value))[value].alias("y_pred")
    )
    ahead = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    return ahead.select(
        *s.keys,
        "step",
        _daily(F.col("_ts"), F.col("step"), df.schema[s.ts].dataType).alias(s.ts),
        "y_pred",
        (F.col("y_pred") * (1 - band)).alias("lower"),
        (F.col("y_pred") * (1 + band)).alias("upper"),
    )


def batch_forecast(df: DataFrame, request: str = "request_id", band: float = NAIVE_BAND) -> DataFrame:
    """Forecast every request of a batch; a rejected request gives one row with the reason."""
    checked = validate_requests(df, request)
    last = df.groupBy(request).agg(F.max(F.struct("date", "price")).alias("_last"))
    joined = attach(checked, last, [request])
    steps = F.when(F.col("accepted"), F.sequence(F.lit(1), F.col("steps"))).otherwise(F.array(F.lit(None).cast("int")))
    ahead = joined.withColumn("step", F.explode(steps))
    price = F.when(F.col("accepted"), F.col("_last.price"))
    return ahead.select(
        request,
        F.when(F.col("accepted"), "success").otherwise("error").alias("status"),
        F.col("reason").alias("error"),
        "step",
        F.to_date(F.col("_last.date") + F.make_dt_interval(F.col("step"))).alias("date"),
        price.alias("y_pred"),
        (price * (1 - band)).alias("lower"),
        (price * (1 + band)).alias("upper"),
    )


# supervised models


def lagged_training(features: Sequence[str], target: str, horizon: int = 1) -> Feature:
    """Training rows: features of ``horizon`` rows ago (``x_*``) beside the target of this row."""

    def build(df: DataFrame, s: Series) -> DataFrame:
        w = s.window()
        return df.withColumns({f"x_{c}": F.lag(c, horizon).over(w) for c in features}).withColumn("label", F.col(target))

    return Feature(horizon, build)


def fit_forecaster(
    df: DataFrame, s: Series, features: Sequence[str], target: str, algo: str = "linear", horizon: int = 1, **settings
) -> PipelineModel:
    """One model over all series from features to the target ``horizon`` rows ahead."""
    learners = {"linear": LinearRegression, "gbt": GBTRegressor}
    if algo not in learners:
        raise ValueError(f"unknown algorithm: {algo}")
    inputs = [f"x_{c}" for c in features]
    train = add_features(df, s, lagged_training(features, target, horizon)).select("label", *inputs).dropna()
    assembler = VectorAssembler(inputCols=inputs, outputCol="_x")
    learner = learners[algo](featuresCol="_x", labelCol="label", predictionCol="y_pred", **settings)
    return Pipeline(stages=[assembler, learner]).fit(train)


def _as_inputs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({f"x_{c}": F.col(c) for c in features})


def predict(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add ``y_pred`` for rows with all features."""
    known = _as_inputs(df.dropna(subset=list(features)), features)
    return model.transform(known).drop("_x", *[f"x_{c}" for c in features])


def predict_next(model: PipelineModel, df: DataFrame, s: Series, features: Sequence[str]) -> DataFrame:
    """Forecast from the latest row of each series."""
    return predict(model, tail(df, s, 1), features)


def latest_values(df: DataFrame, s: Series, value: str, n: int) -> DataFrame:
    """The last n values of each series, newest first, as an array; a shorter series gives a shorter array."""
    recent = tail(df.select(*s.keys, s.ts, *s.tie, value), s, n)
    order = F.sort_array(F.collect_list(F.struct(s.ts, *s.tie, value)), asc=False)
    grouped = recent.groupBy(*s.keys).agg(order.alias("_rows"), F.max(s.ts).alias(s.ts))
    values = F.transform("_rows", lambda x: x[value].cast("double"))
    return grouped.select(*s.keys, s.ts, values.alias("recent"))


def forecast_recursive(
    model: Callable[[DataFrame], DataFrame], df: DataFrame, s: Series, value: str, lags: int, steps: int
) -> DataFrame:
    """Multi-step forecast that feeds each step back, for any model on lag features.

    ``model`` adds ``y_pred`` to rows with ``lag_1`` .. ``lag_n``; a series shorter than the lags gets its steps
    with null forecasts. All series advance together: the
    table has one row per series, the loop is over steps only, and each step's table is written so
    that the plan does not grow with the steps.
    """
    state = settle(latest_values(df, s, value, lags), "state").withColumn("_path", F.array().cast("array<double>"))
    for _ in range(steps):
        seen = state.withColumns({f"lag_{k}": F.get("recent", k - 1) for k in range(1, lags + 1)})
        advanced = model(seen).select(
            *s.keys,
            s.ts,
            F.when(F.size("recent") < lags, F.col("recent")).otherwise(F.slice(F.concat(F.array("y_pred"), F.col("recent")), 1, lags)).alias("recent"),
            F.concat("_path", F.array(F.when(F.size("recent") == lags, F.col("y_pred")))).alias("_path"),
        )
        state = settle(advanced, "state")
    return _path_rows(state, s, df)


def _path_rows(state: DataFrame, s: Series, df: DataFrame) -> DataFrame:
    out = state.select(*s.keys, F.col(s.ts).alias("_ts"), F.posexplode("_path").alias("_i", "y_pred"))
    step = F.col("_i") + 1
    return out.select(*s.keys, step.alias("step"), _daily(F.col("_ts"), step, df.schema[s.ts].dataType).alias(s.ts), "y_pred")


def forecast_linear(
    df: DataFrame, s: Series, value: str, weights: Sequence[float], intercept: float, steps: int
) -> DataFrame:
    """Recursive forecast of a linear lag model (``weights[0]`` on the newest value), in one projection."""
    n = len(weights)
    w = F.array(*[F.lit(float(x)) for x in weights])

    def advance(recent: Column, _: Column) -> Column:
        window = F.slice(recent, 1, n)
        total = F.aggregate(F.zip_with(window, w, lambda a, b: a * b), F.lit(float(intercept)), lambda a, x: a + x)
        return F.concat(F.array(total), recent)

    grown = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("recent"), advance)
    state = latest_values(df, s, value, n).withColumn("_path", F.reverse(F.slice(grown, 1, steps)))
    return _path_rows(state, s, df)


def forecast_direct(
    models: Mapping[int, PipelineModel], df: DataFrame, s: Series, features: Sequence[str]
) -> DataFrame:
    """One model per horizon, all applied to the latest rows: (keys, step, ts, y_pred)."""
    latest = _as_inputs(tail(df, s, 1).dropna(subset=list(features)), features)
    wide = latest
    for step, model in sorted(models.items()):
        wide = model.transform(wide).withColumnRenamed("y_pred", f"_y{step}").drop("_x")
    rows = F.array(*[F.struct(F.lit(h).alias("step"), F.col(f"_y{h}").alias("y_pred")) for h in sorted(models)])
    ahead = wide.select(*s.keys, F.col(s.ts).alias("_ts"), F.inline(rows))
    return ahead.select(*s.keys, "step", _daily(F.col("_ts"), F.col("step"), df.schema[s.ts].dataType).alias(s.ts), "y_pred")


# intervals


def error_spread(errors: DataFrame, keys: Sequence[str], error: str, levels: Sequence[float] = LEVELS) -> DataFrame:
    """Per series: quantiles of past errors for each level, and their deviation and variance."""
    wanted = {}
    for level in levels:
        name = round(level * 100)
        wanted[f"low_{name}"] = (error, (1 - level) / 2)
        wanted[f"high_{name}"] = (error, 1 - (1 - level) / 2)
    bounds = quantiles(errors, keys, wanted)
    moments = errors.groupBy(*keys).agg(F.stddev_pop(error).alias("std_dev"), F.var_pop(error).alias("variance"))
    return settle(attach(moments, bounds, keys), "spread")


def interval(
    forecasts: DataFrame, errors: DataFrame, keys: Sequence[str], error: str = "error", levels: Sequence[float] = LEVELS
) -> DataFrame:
    """Forecasts with one row per level: bounds are the forecast plus quantiles of past errors."""
    spread = error_spread(errors, keys, error, levels)
    rows = F.array(*[
        F.struct(
            F.lit(float(level)).alias("level"),
            (F.col("y_pred") + F.col(f"low_{round(level * 100)}")).alias("lower"),
            (F.col("y_pred") + F.col(f"high_{round(level * 100)}")).alias("upper"),
        )
        for level in levels
    ])
    return attach(forecasts, spread, keys).select(*forecasts.columns, "std_dev", "variance", F.inline(rows))


# scenarios

Change = float | Mapping[str, float]


def _changed(c: str, change: Change) -> Column:
    if not isinstance(change, Mapping):
        return F.col(c) * (1 + float(change))
    if "multiply" in change:
        return F.col(c) * float(change["multiply"])
    if "add" in change:
        return F.col(c) + float(change["add"])
    return F.col(c)


def apply_scenarios(df: DataFrame, scenarios: Mapping[str, Mapping[str, Change]]) -> DataFrame:
    """Every row once per scenario, with ``scenario`` and the changed columns; unknown columns are ignored."""
    touched = sorted({c for m in scenarios.values() for c in m if c in df.columns})
    variants = F.array(*[
        F.struct(
            F.lit(name).alias("scenario"),
            *[(_changed(c, m[c]) if c in m else F.col(c)).cast("double").alias(f"_{c}") for c in touched],
        )
        for name, m in scenarios.items()
    ])
    out = df.select("*", F.inline(variants))
    return out.select("scenario", *[F.col(f"_{c}").alias(c) if c in touched else F.col(c) for c in df.columns])


#: Changes in percent that count as none: sums in another order differ by less.
FLAT_PCT = 1e-9


def scenario_delta(scenarios: DataFrame, base: DataFrame, keys: Sequence[str], value: str = "y_pred") -> DataFrame:
    """Change of each scenario's forecast against the base in percent, and its direction (flat up to ``FLAT_PCT``)."""
    known = base.select(*keys, F.col(value).alias("base"))
    out = attach(scenarios, known, keys).withColumn("delta_pct", ratio(F.col(value) - F.col("base"), "base") * 100)
    return out.withColumn("impact", F.when(F.col("delta_pct") > FLAT_PCT, "up").when(F.col("delta_pct") < -FLAT_PCT, "down").otherwise("flat"))


# importance

# Primes that spread positions; the second serves where the first divides the row count.
_SPREAD, _SPREAD_OTHER = 1_000_003, 1_000_033


def permutation_importance(
    model: Callable[[DataFrame], DataFrame], df: DataFrame, s: Series, features: Sequence[str], target: str, seed: int = 42
) -> DataFrame:
    """Growth of the RMSE when one feature is shuffled within its series: (feature, rmse, delta_rmse).

    Row p takes the values of row (a p + b) mod n, a one-to-one mapping, so shuffling is one
    equi-join on (key, position). All features are scored in one pass; ``model`` adds ``y_pred``.
    """
    rows = df.select(*dict.fromkeys([*s.keys, s.ts, *s.tie, *features, target]))
    placed = settle(numbered(rows, s), "placed")
    spread = F.when(F.col("n") % _SPREAD == 0, F.lit(_SPREAD_OTHER)).otherwise(F.lit(_SPREAD))
    wanted = placed.withColumn("_from", F.pmod(F.col("pos") * spread + seed, F.col("n")))
    donors = placed.select(*s.keys, F.col("pos").alias("_from"), *[F.col(c).alias(f"_d_{c}") for c in features])
    paired = attach(wanted, donors, [*s.keys, "_from"])
    variants = [F.struct(F.lit("").alias("feature"), *[F.col(c).alias(f"_v_{c}") for c in features])]
    variants += [
        F.struct(F.lit(f).alias("feature"), *[F.col(f"_d_{c}" if c == f else c).alias(f"_v_{c}") for c in features])
        for f in features
    ]
    many = paired.select(*s.keys, F.col(target).alias("_y"), F.inline(F.array(*variants)))
    scored = model(many.withColumnsRenamed({f"_v_{c}": c for c in features}))
    error = F.col("_y") - F.col("y_pred")
    rmse = settle(scored.groupBy("feature").agg(F.sqrt(F.avg(error * error)).alias("rmse")), "scores")
    base = rmse.where("feature = ''").select("rmse").scalar()
    return rmse.where("feature <> ''").withColumn("delta_rmse", F.col("rmse") - base).orderBy(F.desc("delta_rmse"), "feature")


def model_importance(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features by absolute standardised coefficient (linear) or split importance (trees)."""
    learner = model.stages[-1]
    weights = learner.coefficients if hasattr(learner, "coefficients") else learner.featureImportances
    linear = hasattr(learner, "coefficients")
    spread = df.agg(*[F.stddev_samp(c).alias(c) for c in features])
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("feature"),
            (F.abs(F.lit(float(w)) * F.col(c)) if linear else F.lit(float(w))).alias("importance"),
        )
        for c, w in zip(features, weights.toArray(), strict=True)
    ])
    return spread.select(F.inline(rows)).orderBy(F.desc("importance"), "feature")


# signals


def signal(df: DataFrame, current: str = "current", predicted: str = "y_pred") -> DataFrame:
    """Expected return in percent and Buy / Sell / Hold."""
    move = ratio(F.col(predicted) - F.col(current), current) * 100
    out = df.withColumn("expected_return", move)
    label = F.when(F.col("expected_return") > SIGNAL_PCT, "Buy").when(F.col("expected_return") < -SIGNAL_PCT, "Sell")
    return out.withColumn("signal", label.otherwise("Hold"))


def market_context(df: DataFrame, s: Series, value: str) -> DataFrame:
    """Latest and previous value per series, the move in percent, and its label."""
    two = latest_two(df, s, value)
    move = ratio(F.col("current") - F.col("previous"), "previous") * 100
    out = two.withColumn("recent_change", move)
    label = F.when(F.col("recent_change") > CONTEXT_PCT, "Rising").when(F.col("recent_change") < -CONTEXT_PCT, "Declining")
    return out.withColumn("trend", label.otherwise("Stable"))


def latest_two(df: DataFrame, s: Series, value: str) -> DataFrame:
    """Latest and previous value; a single row counts as both."""
    recent = tail(df.select(*s.keys, s.ts, *s.tie, value), s, 2)
    row = F.struct(s.ts, *s.tie, value)
    return recent.groupBy(*s.keys).agg(F.max(row)[value].alias("current"), F.min(row)[value].alias("previous"))


def risk_level(df: DataFrame, current: str = "current", std: str = "std_dev") -> DataFrame:
    share = ratio(std, current)
    return df.withColumn(
        "risk", F.when(share > RISK_HIGH, "High").when(share > RISK_MEDIUM, "Medium").otherwise("Low")
    )
