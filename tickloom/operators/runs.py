"""Training-history and experiment tables."""
from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import ratio
from tickloom.operators.blocks import Feature, Series, add_features, attach, running

# Name parts of each metric family; defaults of early stopping and of the searches.
FAMILIES = {
    "error": ("mae", "mse", "rmse", "mape", "loss"),
    "accuracy": ("r2", "accuracy", "correlation"),
    "direction": ("direction", "trend", "signal"),
}
PATIENCE = 15
RANDOM_DRAWS = 50


def param_grid(values: Mapping[str, Sequence]) -> list[dict]:
    """Every combination of the given values."""
    return [dict(zip(values, combination, strict=True)) for combination in itertools.product(*values.values())]


def random_draws(df: DataFrame, values: Mapping[str, Sequence], trial: str = "trial", seed: int = 42) -> DataFrame:
    """Add one value per parameter to each trial, picked by a hash of (seed, trial, parameter)."""

    def pick(name: str, options: Sequence) -> Column:
        text = F.concat_ws("|", F.lit(str(seed)), F.col(trial).cast("string"), F.lit(name))
        at = F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(len(options)))
        return F.element_at(F.array(*[F.lit(v) for v in options]), (at + 1).cast("int"))

    return df.withColumns({name: pick(name, options) for name, options in values.items()})


def score_grid(
    df: DataFrame, grid: Sequence[Mapping[str, float]], forecast: Callable[[Mapping[str, Column]], Column], target: str, keys: Sequence[str] = ()
) -> DataFrame:
    """RMSE of a column forecast for every parameter set, all in one pass over the rows.

    Each row is scored once per set and combined on the map side; only one row per set is shuffled.
    """
    names = list(grid[0])
    sets = F.array(*[F.struct(*[F.lit(float(p[n])).alias(n) for n in names]) for p in grid])
    scored = df.select("*", F.explode(sets).alias("_p"))
    error = F.col(target) - forecast({n: F.col(f"_p.{n}") for n in names})
    return scored.groupBy(*keys, *[F.col(f"_p.{n}").alias(n) for n in names]).agg(
        F.sqrt(F.avg(error * error)).alias("rmse")
    )


def best_params(scores: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    best = scores.groupBy(*keys).agg(F.min(F.struct("rmse", *names)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in (*names, "rmse")])


def search(
    grid: Sequence[Mapping], fit_and_score: Callable[..., float]
) -> tuple[Mapping, float, list[tuple[Mapping, float]]]:
    """Fit one MLlib model per parameter set and keep the set with the lowest score."""
    results = [(p, float(fit_and_score(**p))) for p in grid]
    best = min(results, key=lambda item: item[1])
    return best[0], best[1], results


def training_summary(history: DataFrame, run: str = "run_id", epochs: int = 100) -> DataFrame:
    """Final and best losses, best epochs (1-based, first on ties), and whether the run ended early."""

    def at_min(c: str) -> Column:
        return F.min(F.when(F.col(c).isNotNull(), F.struct(c, "epoch")))

    out = history.groupBy(run).agg(
        F.count(F.lit(1)).alias("epochs_trained"),
        F.max(F.struct("epoch", "loss", "val_loss")).alias("_last"),
        at_min("loss").alias("_loss"),
        at_min("val_loss").alias("_val"),
    )
    return out.select(
        run,
        "epochs_trained",
        F.col("_last.loss").alias("final_loss"),
        F.col("_last.val_loss").alias("final_val_loss"),
        F.col("_loss.loss").alias("best_loss"),
        F.col("_val.val_loss").alias("best_val_loss"),
        F.col("_loss.epoch").alias("best_epoch"),
        F.col("_val.epoch").alias("best_val_epoch"),
        (F.col("epochs_trained") < epochs).alias("early_stopped"),
    )


def improvement_rate(history: DataFrame, loss: str = "val_loss", run: str = "run_id") -> DataFrame:
    """Mean relative decrease over the epochs where the loss fell; 0 when it never did."""

    def build(df: DataFrame, s: Series) -> DataFrame:
        return df.withColumn("_before", F.lag(loss).over(s.window()))

    stepped = add_features(history.select(run, "epoch", loss), Series((run,), "epoch"), Feature(1, build))
    fall = F.when(F.col(loss) < F.col("_before"), ratio(F.col("_before") - F.col(loss), "_before"))
    return stepped.groupBy(run).agg(F.coalesce(F.avg(fall), F.lit(0.0)).alias("improvement_rate"))


def early_stop(
    history: DataFrame, loss: str = "val_loss", patience: int = PATIENCE, min_delta: float = 0.0, run: str = "run_id"
) -> DataFrame:
    """Epoch at which training would stop: ``patience`` epochs without an improvement.

    An epoch improves when it beats the best kept loss by more than ``min_delta``. Only epochs
    below all earlier ones can do so; with a ``min_delta`` those few are walked in order.
    """
    s = Series((run,), "epoch")
    rows = history.select(run, "epoch", loss)
    lows = running(rows, s, {"_low": ("min", loss)}, pos=True)

    def build(df: DataFrame, s: Series) -> DataFrame:
        before = F.lag("_low").over(s.window())
        return df.withColumn("_record", before.isNull() | (F.col(loss) < before))

    marked = add_features(lows, s, Feature(1, build))
    records = marked.where("_record").select(run, F.col("pos"), F.col(loss).alias("v"))
    if min_delta > 0:
        ordered = F.sort_array(F.collect_list(F.struct("pos", "v")))
        kept = F.aggregate(
            ordered,
            F.struct(F.lit(None).cast("double").alias("best"), F.array().cast("array<bigint>").alias("at")),
            lambda a, x: F.when(
                a["best"].isNull() | (x["v"] < a["best"] - min_delta),
                F.struct(x["v"].alias("best"), F.concat(a["at"], F.array(x["pos"])).alias("at")),
            ).otherwise(a),
            lambda a: a["at"],
        )
        records = records.groupBy(run).agg(kept.alias("_at")).select(run, F.explode("_at").alias("pos"))
    steps = records.select(run, F.col("pos"), F.lit(True).alias("_better"))
    flagged = attach(lows.select(run, "epoch", "pos"), steps, [run, "pos"])
    since = flagged.withColumn("_at", F.when(F.col("_better"), F.col("pos")))
    last = running(since.select(run, "epoch", "pos", "_at"), s, {"_best": ("last", "_at")})
    waited = last.withColumn("waited", F.col("pos") - F.col("_best.value"))
    return waited.groupBy(run).agg(
        F.min(F.when(F.col("waited") >= patience, F.col("epoch"))).alias("stop_epoch"), F.max("epoch").alias("last_epoch")
    )


def best_run(runs: DataFrame, metric: str, ascending: bool = True, run: str = "run_id") -> DataFrame:
    order = F.asc_nulls_last(metric) if ascending else F.desc_nulls_last(metric)
    return runs.orderBy(order, run).limit(1)


def compare_runs(log: DataFrame, metrics: Sequence[str], run: str = "run_id") -> DataFrame:
    """Runs x metrics from (run, metric, value) rows; a missing metric is null."""
    return log.groupBy(run).pivot("metric", list(metrics)).agg(F.max("value"))


def expired_runs(runs: DataFrame, keep: int, started: str = "started", run: str = "run_id", groups: Sequence[str] = ()) -> DataFrame:
    """Runs beyond the newest ``keep`` of each group (all runs form one group by default).

    The newest ``keep`` are found with a bounded top-n and removed by an anti join, so the rest are
    never sorted.
    """
    if not groups:
        newest = runs.orderBy(F.desc(started), run).limit(keep).select(run)
        return runs.join(newest, run, "left_anti")
    order = Window.partitionBy(*groups).orderBy(F.desc(started), run)
    newest = runs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep).select(*groups, run)
    return runs.join(newest, [*groups, run], "left_anti")


def metric_family(name: Column) -> Column:
    """error, accuracy or direction by the metric's name; direction wins over accuracy."""
    lowered = F.lower(name)
    out = None
    for family in ("direction", "error", "accuracy"):
        test = lowered.rlike("|".join(FAMILIES[family]))
        out = F.when(test, family) if out is None else out.when(test, family)
    return out.otherwise("other")


def top_metrics(log: DataFrame, k: int, by: str = "value") -> DataFrame:
    """The k largest metrics of each family."""
    named = log.withColumn("family", metric_family(F.col("metric")))
    order = Window.partitionBy("family").orderBy(F.desc(by), *[c for c in log.columns if c != by])
    return named.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")
