"""Queries: forecast metrics and residual diagnostics."""
from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.columns import rounded
from tickloom.operators import metrics as m
from tickloom.operators import residuals as res
from tickloom.operators import sequences
from tickloom.operators.blocks import Series, attach
from tickloom.plans import fixtures as fx
from tickloom.plans.features import STAMP
from tickloom.plans.registry import query, r
from tickloom.plans.training import RANKED, WALK_SQL
from tickloom.sources import writers
from tickloom.sources.session import new_path

MODEL = Series(("model", "key"), "ts")

E = "(y_true - y_pred)"
# metric -> SQL over rows with step (change of truth) and hit (same direction)
METRIC_SQL = {
    "n": f"count({E})",
    "mse": f"avg({E} * {E})",
    "rmse": f"sqrt(avg({E} * {E}))",
    "mae": f"avg(abs{E})",
    "mape": f"avg(abs({E} / nullif(y_true, 0))) * 100",
    "smape": f"avg(abs{E} * 2 / nullif(abs(y_true) + abs(y_pred), 0)) * 100",
    "r2": f"1 - sum({E} * {E}) / (var_pop(y_true) * count(*))",
    "direction_accuracy": "coalesce(avg(hit) * 100, 0)",
    "residual_mean": f"avg{E}",
    "residual_std": f"stddev_pop{E}",
    "residual_min": f"min{E}",
    "residual_max": f"max{E}",
    "median_absolute_error": f"median(abs{E})",
    "max_error": f"max(abs{E})",
    "explained_variance": f"1 - var_pop{E} / var_pop(y_true)",
    "relative_rmse": f"sqrt(avg({E} * {E})) / avg(y_true) * 100",
    "relative_mae": f"avg(abs{E}) / avg(y_true) * 100",
    "theil_u": f"sqrt(avg({E} * {E})) / sqrt(avg(step * step))",
    "huber_loss": f"avg(CASE WHEN abs{E} <= 1 THEN {E} * {E} / 2 ELSE abs{E} - 0.5 END)",
    **{f"pinball_{q}": f"avg(greatest({q / 100} * {E}, ({q / 100} - 1) * {E}))" for q in (10, 50, 90)},
    "directional_loss": f"0.5 * avg({E} * {E}) + 0.5 * (1 - avg(hit))",
    "target_mean": "avg(y_true)",
    "target_std": "stddev_pop(y_true)",
    "target_min": "min(y_true)",
    "target_max": "max(y_true)",
    "prediction_mean": "avg(y_pred)",
    "prediction_std": "stddev_pop(y_pred)",
}


# single values or counts, equal in both engines as they are
EXACT = ("n", "residual_min", "residual_max", "max_error", "target_min", "target_max")


def _digits(name: str) -> int:
    return 2 if name in ("mse", "directional_loss") else 4


def _steps_sql(source: str, keys: str, order: str = "ts") -> str:
    w = f"OVER (PARTITION BY {keys} ORDER BY {order})"
    return f"""SELECT *, CASE WHEN step IS NULL THEN NULL WHEN sign(step) = sign(pstep) THEN 1.0 ELSE 0.0 END AS hit FROM (
      SELECT *, y_true - lag(y_true) {w} AS step, y_pred - lag(y_pred) {w} AS pstep FROM {source})"""


def _metric_sql(names, keys: str) -> str:
    shown = ", ".join(f"{METRIC_SQL[n]} AS {n}" if n in EXACT else r(METRIC_SQL[n], _digits(n), n) for n in names)
    return f"SELECT {keys}, {shown} FROM steps GROUP BY {keys}"


def _rounded_metrics(df, names):
    return df.withColumns({n: F.round(n, _digits(n)) for n in names if n not in EXACT})


def _metric_query(name: str, names, fixture: str = "models", keys: str = "model, key"):
    @query(name, fx.sql(_metric_sql(names, keys), fixture, steps=_steps_sql(fixture, keys)))
    def build(spark, d):
        s = Series(tuple(k.strip() for k in keys.split(",")), "ts")
        scored = m.metrics(getattr(fx, fixture)(spark, d), s, median="median_absolute_error" in names)
        return _rounded_metrics(scored.select(*s.keys, *names), names)


_metric_query("m1_m5_errors", ["n", "mse", "rmse", "mae", "mape", "smape", "r2"])
_metric_query("m6_direction_accuracy", ["direction_accuracy"])
_metric_query("m7_residual_moments", ["residual_mean", "residual_std", "residual_min", "residual_max"])
_metric_query("m8_median_and_max_error", ["median_absolute_error", "max_error"])
_metric_query("m9_m10_relative", ["explained_variance", "relative_rmse", "relative_mae"])
_metric_query("m11_theil_u", ["theil_u"])
_metric_query("m12_m14_losses", ["huber_loss", "pinball_10", "pinball_50", "pinball_90", "directional_loss"])
_metric_query("m15_all_metrics", list(METRIC_SQL), "predictions", "key")
_metric_query("m17_data_summary", ["n", "target_mean", "target_std", "target_min", "target_max", "prediction_mean", "prediction_std"])

WEIGHT_SQL = " + ".join(f"(u >= '{b}')::INTEGER" for b in m.POISSON_BOUNDS)
SAMPLES = m.BOOTSTRAP_SAMPLES


@query(
    "m16_bootstrap",
    fx.sql(
        "SELECT key, metric, "
        + ", ".join(
            [r("quantile_cont(v, 0.025)", 3, "lower"), r("quantile_cont(v, 0.975)", 3, "upper"), r("avg(v)", 3, "mean"), r("stddev_pop(v)", 3, "std")]
        )
        + " FROM reps UNPIVOT (v FOR metric IN (rmse, mae, mape, r2, direction_accuracy)) GROUP BY ALL",
        "predictions",
        steps=_steps_sql("predictions", "key"),
        hashed=f"""SELECT key, y_true, y_pred, hit, g, md5('42|' || key || '|' || CAST(ts AS VARCHAR) || '|' || g) AS h
          FROM steps, (SELECT range AS g FROM range(0, {SAMPLES // 4}))""",
        drawn="SELECT key, y_true, y_pred, hit, g * 4 + i AS b, substr(h, 8 * i + 1, 8) AS u FROM hashed, (SELECT CAST(range AS INTEGER) AS i FROM range(0, 4))",
        weighted=f"SELECT *, ({WEIGHT_SQL})::DOUBLE AS w FROM drawn",
        moments="""SELECT key, b, sum(w) AS sw, sum(w * y_true) / sum(w) AS my FROM weighted GROUP BY ALL""",
        reps=f"""SELECT key, b, sqrt(sum(w * {E} * {E}) / any_value(sw)) AS rmse, sum(w * abs{E}) / any_value(sw) AS mae,
          sum(w * abs({E} / y_true)) / any_value(sw) * 100 AS mape,
          1 - sum(w * {E} * {E}) / sum(w * (y_true - my) * (y_true - my)) AS r2,
          sum(w * hit) / sum(w) FILTER (WHERE hit IS NOT NULL) * 100 AS direction_accuracy
          FROM weighted JOIN moments USING (key, b) GROUP BY key, b""",
    ),
)
def m16(spark, d):
    return rounded(m.bootstrap(fx.predictions(spark, d), fx.QUOTE), 3)


FOLD_NAMES = ["rmse", "mae", "mape", "r2", "direction_accuracy"]
WALK_NAMES = ["rmse", "mae", "mape"]


def last_price(train, test):
    """Forecast: the last training price of the fold."""
    last = train.groupBy("key", "fold").agg(F.max_by("sell", "ts").alias("y_pred"))
    return attach(test, last, ["key", "fold"]).withColumnRenamed("sell", "y_true")


def mean_price(train, test):
    """Forecast: the mean training price of the fold."""
    mean = train.groupBy("key", "fold").agg(F.avg("sell").alias("y_pred"))
    return attach(test, mean, ["key", "fold"]).withColumnRenamed("sell", "y_true")


FOLD_CTES = {
    "ranked": RANKED.format("order_quotes"),
    "folds": """SELECT *, CASE WHEN pos < n - (6 - fold) * (n // 6) THEN 'train' WHEN pos < n - (5 - fold) * (n // 6) THEN 'test' END AS part
      FROM ranked, (SELECT range AS fold FROM range(1, 6))""",
    "forecasts": """SELECT t.key, t.fold, t.ts, t.sell AS y_true, f.y_pred FROM folds t JOIN
      (SELECT key, fold, avg(sell) AS y_pred FROM folds WHERE part = 'train' GROUP BY ALL) f USING (key, fold) WHERE part = 'test'""",
    "steps": _steps_sql("forecasts", "key, fold"),
    "scores": "SELECT key, fold, " + ", ".join(f"{METRIC_SQL[n]} AS {n}" for n in FOLD_NAMES) + " FROM steps GROUP BY ALL",
}


@query(
    "m18_fold_metrics",
    fx.sql(
        f"""SELECT key, metric, {r('avg(v)', 4, 'mean')}, {r('stddev_pop(v)', 4, 'std')}, {r('min(v)', 4, 'min')}, {r('max(v)', 4, 'max')}, count(*) AS n_folds
        FROM scores UNPIVOT (v FOR metric IN ({', '.join(FOLD_NAMES)})) GROUP BY ALL""",
        "order_quotes",
        **FOLD_CTES,
    ),
)
def m18(spark, d):
    folds = sequences.ts_folds(fx.order_quotes(spark, d), fx.QUOTE, 5)
    scored = m.fold_metrics(sequences.backtest(folds, mean_price), fx.QUOTE)
    return rounded(m.fold_summary(scored, ["key"], FOLD_NAMES), 4)


WALK_CTES = {
    "ranked": RANKED.format("quotes"),
    "walk": WALK_SQL,
    "forecasts": """SELECT t.key, t.fold, t.ts, t.sell AS y_true, f.y_pred FROM walk t JOIN
      (SELECT key, fold, arg_max(sell, ts) AS y_pred FROM walk WHERE part = 'train' GROUP BY ALL) f USING (key, fold) WHERE part = 'test'""",
}


def _walk(spark, d):
    folds = sequences.walk_forward(fx.quotes(spark, d).drop("buy"), fx.QUOTE, 250, 100, 20)
    return sequences.backtest(folds, last_price)


@query(
    "m19_walk_forward_folds",
    fx.sql(_metric_sql(WALK_NAMES, "key, fold"), "quotes", **WALK_CTES, steps=_steps_sql("forecasts", "key, fold")),
)
def m19(spark, d):
    scored = m.fold_metrics(_walk(spark, d), fx.QUOTE)
    return _rounded_metrics(scored.select("key", "fold", *WALK_NAMES), WALK_NAMES)


@query(
    "m19_walk_forward_pooled",
    fx.sql(_metric_sql(FOLD_NAMES, "key"), "quotes", **WALK_CTES, steps=_steps_sql("forecasts", "key", "fold, ts")),
)
def m19_pooled(spark, d):
    scored = m.pooled_metrics(_walk(spark, d), fx.QUOTE)
    return _rounded_metrics(scored.select("key", *FOLD_NAMES), FOLD_NAMES)


MODEL_SCORES = {
    "steps": _steps_sql("models", "model, key"),
    "scores": "SELECT model, key, " + ", ".join(f"{METRIC_SQL[n]} AS {n}" for n in FOLD_NAMES) + " FROM steps GROUP BY ALL",
}


def _extremes_sql() -> str:
    parts = []
    for n in FOLD_NAMES:
        up, down = ("ASC", "DESC") if n in m.LOWER_IS_BETTER else ("DESC", "ASC")
        parts.append(
            f"""SELECT DISTINCT key, '{n}' AS metric, first_value(model) OVER (PARTITION BY key ORDER BY {n} {up}, model) AS best_model,
            first_value(model) OVER (PARTITION BY key ORDER BY {n} {down}, model) AS worst_model FROM scores"""
        )
    return "\nUNION ALL ".join(parts)


@query("m20_compare_models", fx.sql(_extremes_sql(), "models", **MODEL_SCORES))
def m20(spark, d):
    return m.compare_models(m.metrics(fx.models(spark, d), MODEL, median=False), ["key"])


@query(
    "m21_comparison_table",
    fx.sql("SELECT model, key, " + ", ".join(r(n, 4, n) for n in FOLD_NAMES) + " FROM scores", "models", **MODEL_SCORES),
)
def m21(spark, d):
    scored = m.metrics(fx.models(spark, d), MODEL, median=False)
    return rounded(m.comparison_table(scored, "model", ["key"]), 4)


# residuals

MOMENTS = {
    "n": "count(*)",
    "mean": "avg(error)",
    "std": "stddev_pop(error)",
    "min": "min(error)",
    "max": "max(error)",
    "q25": "quantile_cont(error, 0.25)",
    "q50": "quantile_cont(error, 0.5)",
    "q75": "quantile_cont(error, 0.75)",
    "skewness": "avg(pow(error - me, 3)) / pow(stddev_pop(error), 3)",
    "kurtosis": "avg(pow(error - me, 4)) / pow(stddev_pop(error), 4) - 3",
    "durbin_watson": "sum(de * de) / sum(error * error)",
    "bp_correlation": "corr(y_pred, error * error)",
    "white_correlation": "corr(y_pred * y_pred, error * error)",
}
STAT_CTES = {
    "errors": f"""SELECT model, key, ts, y_true, y_pred, {E} AS error, {E} - lag({E}) OVER (PARTITION BY model, key ORDER BY ts) AS de,
      avg({E}) OVER (PARTITION BY model, key) AS me FROM models""",
    "stats": "SELECT model, key, " + ", ".join(f"{text} AS {n}" for n, text in MOMENTS.items()) + " FROM errors GROUP BY ALL",
}


def _stats_query(name, names):
    shown = ", ".join(n if n == "n" else r(n, 4, n) for n in names)

    @query(name, fx.sql(f"SELECT model, key, {shown} FROM stats", "models", **STAT_CTES))
    def build(spark, d):
        return rounded(res.residual_stats(fx.models(spark, d), MODEL).select("model", "key", *names), 4)


_stats_query("r1_residual_stats", list(MOMENTS)[:10])


@query(
    "r2_standardised",
    fx.sql(f"SELECT {STAMP}, {r(f'{E} / stddev_pop({E}) OVER (PARTITION BY key)', 6, 'standardised')} FROM predictions", "predictions"),
)
def r2(spark, d):
    return rounded(fx.dated(res.standardised(fx.predictions(spark, d), fx.QUOTE).select("key", "ts", "standardised")), 6)


NORMAL_CTES = {
    "jb": "SELECT *, n / 6.0 * (skewness * skewness + kurtosis * kurtosis / 4) AS jarque_bera FROM stats",
    "k1": """SELECT *, skewness * sqrt((n + 1.0) * (n + 3) / (6.0 * (n - 2))) AS y,
      3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9)) AS b2,
      (kurtosis + 3 - 3.0 * (n - 1) / (n + 1)) / sqrt(24.0 * n * (n - 2) * (n - 3) / ((n + 1.0) * (n + 1) * (n + 3) * (n + 5))) AS x,
      6.0 * (n * n - 5 * n + 2) / ((n + 7.0) * (n + 9)) * sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3))) AS rb FROM jb""",
    "k2": "SELECT *, -1 + sqrt(2 * (b2 - 1)) AS w2, 6 + 8 / rb * (2 / rb + sqrt(1 + 4 / (rb * rb))) AS a FROM k1",
    "k3": """SELECT *, ln(y / sqrt(2 / (w2 - 1)) + sqrt(pow(y / sqrt(2 / (w2 - 1)), 2) + 1)) / sqrt(0.5 * ln(w2)) AS zs,
      1 + x * sqrt(2 / (a - 4)) AS dn FROM k2""",
    "k4": "SELECT *, (1 - 2 / (9 * a) - sign(dn) * pow((1 - 2 / a) / abs(dn), 1.0 / 3)) / sqrt(2 / (9 * a)) AS zk FROM k3",
    "normals": "SELECT *, zs * zs + zk * zk AS dagostino, exp(-jarque_bera / 2) AS jarque_bera_p, exp(-(zs * zs + zk * zk) / 2) AS dagostino_p FROM k4",
}
NORMAL_NAMES = ["jarque_bera", "jarque_bera_p", "dagostino", "dagostino_p"]


@query(
    "r3_r4_normality",
    fx.sql("SELECT model, key, " + ", ".join(r(n, 3, n) for n in NORMAL_NAMES) + " FROM normals", "models", **STAT_CTES, **NORMAL_CTES),
)
def r3(spark, d):
    stats = res.normality(res.residual_stats(fx.models(spark, d), MODEL))
    return rounded(stats.select("model", "key", *NORMAL_NAMES), 3)


@query("r5_shapiro_wilk")
def r5(spark, d):
    return rounded(res.shapiro_wilk(fx.predictions(spark, d), fx.QUOTE), 4)


DW_LABEL = f"CASE WHEN durbin_watson < 1.5 THEN '{res.POSITIVE}' WHEN durbin_watson > 2.5 THEN '{res.NEGATIVE}' ELSE '{res.NONE}' END"
HET_LABEL = f"CASE WHEN abs(bp_correlation) > 0.3 THEN '{res.HETERO}' ELSE '{res.HOMO}' END"


@query(
    "r6_durbin_watson",
    fx.sql(f"SELECT model, key, {r('durbin_watson', 5, 'durbin_watson')}, {DW_LABEL} AS label FROM stats", "models", **STAT_CTES),
)
def r6(spark, d):
    stats = res.residual_stats(fx.models(spark, d), MODEL)
    out = stats.select("model", "key", "durbin_watson", res.durbin_watson_label(F.col("durbin_watson")).alias("label"))
    return rounded(out, 5)


@query(
    "r7_heteroscedasticity",
    fx.sql(
        f"SELECT model, key, {r('bp_correlation', 5, 'bp_correlation')}, {r('white_correlation', 5, 'white_correlation')}, {HET_LABEL} AS label FROM stats",
        "models",
        **STAT_CTES,
    ),
)
def r7(spark, d):
    stats = res.residual_stats(fx.models(spark, d), MODEL)
    label = res.spread_label(F.col("bp_correlation")).alias("label")
    return rounded(stats.select("model", "key", "bp_correlation", "white_correlation", label), 5)


FLAGGED = {
    "bounds": """SELECT model, key, stddev_pop(error) AS sd, quantile_cont(error, 0.25) AS q1, quantile_cont(error, 0.75) AS q3 FROM errors GROUP BY ALL""",
    "flagged": """SELECT errors.*, coalesce(abs(error / nullif(sd, 0)) > 3, false) AS z,
      error < q1 - 1.5 * (q3 - q1) OR error > q3 + 1.5 * (q3 - q1) AS q FROM errors JOIN bounds USING (model, key)""",
    "outliers": """SELECT model, key, count(*) FILTER (WHERE z) AS z_count, count(*) FILTER (WHERE z) / count(*)::DOUBLE * 100 AS z_pct,
      count(*) FILTER (WHERE q) AS iqr_count, count(*) FILTER (WHERE q) / count(*)::DOUBLE * 100 AS iqr_pct FROM flagged GROUP BY ALL""",
}


@query(
    "r8_residual_outliers",
    fx.sql(f"SELECT model, key, z_count, {r('z_pct', 6, 'z_pct')}, iqr_count, {r('iqr_pct', 6, 'iqr_pct')} FROM outliers", "models", **STAT_CTES, **FLAGGED),
)
def r8(spark, d):
    return rounded(res.residual_outlier_summary(fx.models(spark, d), MODEL), 6)


@query(
    "r8_residual_outlier_rows",
    fx.sql("SELECT model, key, CAST(ts AS VARCHAR) AS ts, z AS z_outlier, q AS iqr_outlier FROM flagged WHERE z OR q", "models", **STAT_CTES, **FLAGGED),
)
def r8_rows(spark, d):
    rows = res.residual_outliers(fx.models(spark, d), MODEL).where("z_outlier or iqr_outlier")
    return fx.dated(rows.select("model", "key", "ts", "z_outlier", "iqr_outlier"))


@query("r9_residual_series", fx.sql(f"SELECT {STAMP}, y_pred, y_true - y_pred AS error FROM predictions", "predictions"))
def r9(spark, d):
    return fx.dated(res.residual_series(fx.predictions(spark, d), fx.QUOTE))


CLASS_CTES = {
    "scores": MODEL_SCORES["scores"],
    "ranks": """SELECT *, CASE WHEN mape < 1 THEN 1 WHEN mape < 3 THEN 2 WHEN mape < 5 THEN 3 WHEN mape < 10 THEN 4 ELSE 5 END AS mr,
      CASE WHEN r2 > 0.9 THEN 1 WHEN r2 > 0.8 THEN 2 WHEN r2 > 0.7 THEN 3 WHEN r2 > 0.5 THEN 4 ELSE 5 END AS rr,
      CASE WHEN direction_accuracy > 70 THEN 1 WHEN direction_accuracy > 60 THEN 3 WHEN direction_accuracy > 50 THEN 4 ELSE 5 END AS dr FROM scores""",
    "classes": """SELECT *, c[mr] AS mape_class, c[rr] AS r2_class, c[dr] AS direction_class, c[greatest(mr, rr, dr)] AS overall
      FROM ranks, (SELECT ['Excellent', 'Very Good', 'Good', 'Fair', 'Poor'] AS c)""",
}
CLASS_NAMES = ["mape_class", "r2_class", "direction_class", "overall"]


@query(
    "r10_classify",
    fx.sql(f"SELECT model, key, {', '.join(CLASS_NAMES)} FROM classes", "models", steps=MODEL_SCORES["steps"], **CLASS_CTES),
)
def r10(spark, d):
    scored = m.metrics(fx.models(spark, d), MODEL, median=False)
    return res.classify(scored).select("model", "key", *CLASS_NAMES)


ADVICE_SQL = f"""CASE WHEN len(advice) = 0 THEN '{res.ADVICE['fine']}' ELSE array_to_string(advice, '; ') END"""
REPORT_CTES = {
    "steps": MODEL_SCORES["steps"],
    **CLASS_CTES,
    **STAT_CTES,
    **NORMAL_CTES,
    **FLAGGED,
    "joined": f"""SELECT c.*, s.durbin_watson, s.bp_correlation, o.z_pct, s.dagostino, {DW_LABEL} AS autocorrelation, list_filter([
      CASE WHEN mape > 5 THEN '{res.ADVICE['mape']}' END, CASE WHEN r2 < 0.8 THEN '{res.ADVICE['r2']}' END,
      CASE WHEN direction_accuracy < 60 THEN '{res.ADVICE['direction']}' END,
      CASE WHEN least(jarque_bera_p, dagostino_p) < 0.05 THEN '{res.ADVICE['normality']}' END,
      CASE WHEN abs(bp_correlation) > 0.3 THEN '{res.ADVICE['hetero']}' END,
      CASE WHEN durbin_watson < 1.5 OR durbin_watson > 2.5 THEN '{res.ADVICE['autocorrelation']}' END,
      CASE WHEN z_pct > 5 THEN '{res.ADVICE['outliers']}' END], lambda x: x IS NOT NULL) AS advice
      FROM classes c JOIN normals s ON c.model = s.model AND c.key = s.key JOIN outliers o ON c.model = o.model AND c.key = o.key""",
}
REPORT_NUMBERS = ["rmse", "mape", "r2", "direction_accuracy", "durbin_watson", "bp_correlation", "z_pct"]


@query(
    "r11_r12_evaluation_report",
    fx.sql(
        f"SELECT model, key, overall, autocorrelation, {', '.join(r(n, 4, n) for n in REPORT_NUMBERS)}, {ADVICE_SQL} AS recommendations FROM joined",
        "models",
        **REPORT_CTES,
    ),
)
def r12(spark, d):
    return _report_shape(res.evaluation_report(fx.models(spark, d), MODEL))


def _report_shape(report):
    out = report.select(
        "model", "key", "overall", "autocorrelation", *REPORT_NUMBERS, F.array_join("recommendations", "; ").alias("recommendations")
    )
    return rounded(out, 4)


@query(
    "s9_write_report",
    fx.sql(f"SELECT model, key, overall, {r('rmse', 4, 'rmse')}, {ADVICE_SQL} AS recommendations FROM joined", "models", **REPORT_CTES),
)
def s9(spark, d):
    path = new_path(spark, "report")
    report = res.evaluation_report(fx.models(spark, d), MODEL)
    writers.write_report(report, path)
    stored = spark.read.schema(report.schema).json(path)
    return _report_shape(stored).select("model", "key", "overall", "rmse", "recommendations")
