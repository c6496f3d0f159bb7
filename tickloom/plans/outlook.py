"""Queries: forecasts and run analytics."""
from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.columns import rounded
from tickloom.operators import forecast as fc
from tickloom.operators import lags, linear, runs
from tickloom.operators.blocks import Series, add_features
from tickloom.operators.metrics import fold_metrics, metrics
from tickloom.operators.residuals import with_errors
from tickloom.plans import fixtures as fx
from tickloom.plans.features import SERIES, STAMP
from tickloom.plans.intake import REQUEST_SQL, VERDICT_SQL, forecast_requests
from tickloom.plans.registry import query, r
from tickloom.plans.scoring import MODEL, MODEL_SCORES
from tickloom.plans.training import RANKED
from tickloom.sources.session import settle

LATEST = "SELECT key, max(ts) AS last, arg_max(sell, ts) AS price FROM {0} GROUP BY key"


@query(
    "f1_naive_forecast",
    fx.sql(
        """SELECT key, step, CAST(CAST(last + step AS DATE) AS VARCHAR) AS ts, price AS y_pred, price * 0.98::DOUBLE AS lower, price * 1.02::DOUBLE AS upper
        FROM latest, (SELECT CAST(range AS INTEGER) AS step FROM range(1, 8))""",
        "supplier_quotes",
        latest=LATEST.format("supplier_quotes"),
    ),
)
def f1(spark, d):
    return fx.dated(fc.naive_forecast(fx.supplier_quotes(spark, d), fx.QUOTE, "sell", 7))


@query(
    "f2_batch_forecast",
    fx.sql(
        """SELECT request_id, 'success' AS status, reason AS error, step, CAST(CAST(CAST(last AS DATE) + step AS DATE) AS VARCHAR) AS date,
        price AS y_pred, price * 0.98::DOUBLE AS lower, price * 1.02::DOUBLE AS upper
        FROM verdicts JOIN latest USING (request_id), (SELECT CAST(range AS INTEGER) AS step FROM range(1, 31))
        WHERE reason IS NULL AND step <= steps
        UNION ALL SELECT request_id, 'error', reason, NULL, NULL, NULL, NULL, NULL FROM verdicts WHERE reason IS NOT NULL""",
        requests_in=REQUEST_SQL,
        verdicts=VERDICT_SQL,
        latest="SELECT request_id, max(date) AS last, arg_max(price, date) AS price FROM requests_in GROUP BY ALL",
    ),
)
def f2(spark, d):
    return fx.dated(fc.batch_forecast(forecast_requests(spark, d)))


def _slope_sql(source: str, h: int) -> str:
    return f"""SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM
      (SELECT sell AS y, lag(sell, {h}) OVER ({SERIES}) AS x FROM {source}) WHERE x IS NOT NULL"""


@query(
    "f3_fit_forecaster",
    fx.sql(f"SELECT {STAMP}, {r('a + b * sell', 3, 'y_pred')} FROM order_quotes, line", "order_quotes", line=_slope_sql("order_quotes", 1)),
)
def f3(spark, d):
    rows = fx.order_quotes(spark, d)
    model = fc.fit_forecaster(rows, fx.QUOTE, ["sell"], "sell", "linear", solver="normal")
    return rounded(fx.dated(fc.predict(model, rows, ["sell"]).select("key", "ts", "y_pred")), 3)


@query(
    "f4_predict_next",
    fx.sql(
        f"SELECT key, {r('a + b * price', 3, 'y_pred')} FROM latest, line",
        "order_quotes",
        line=_slope_sql("order_quotes", 1),
        latest=LATEST.format("order_quotes"),
    ),
)
def f4(spark, d):
    rows = fx.order_quotes(spark, d)
    model = fc.fit_forecaster(rows, fx.QUOTE, ["sell"], "sell", "linear", solver="normal")
    return rounded(fc.predict_next(model, rows, fx.QUOTE, ["sell"]).select("key", "y_pred"), 3)


@query("f3_gbt_forecaster")
def f3_gbt(spark, d):
    lagged = add_features(fx.quotes(spark, d), fx.QUOTE, lags.lags(["sell"], [1, 7]))
    features = ["sell", "sell_lag_1", "sell_lag_7"]
    model = fc.fit_forecaster(lagged, fx.QUOTE, features, "sell", "gbt", maxIter=5, maxDepth=3, seed=42)
    return rounded(fx.dated(fc.predict_next(model, lagged, fx.QUOTE, features).select("key", "ts", "y_pred")), 3)


WEIGHTS, INTERCEPT = (0.5, 0.3, 0.15), 10.0


def _recursive_sql(source: str) -> str:
    return f"""WITH RECURSIVE base AS ({fx.FIXTURE_SQL[source][1]}),
      three AS (SELECT key, max(ts) AS last, list(sell ORDER BY ts DESC) AS v FROM
        (SELECT * FROM base QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC) <= 3) GROUP BY key),
      walk AS (SELECT key, last, 0 AS step, v[1] AS p1, v[2] AS p2, v[3] AS p3 FROM three
        UNION ALL SELECT key, last, step + 1, 10.0 + 0.5 * p1 + 0.3 * p2 + 0.15 * p3, p1, p2 FROM walk WHERE step < 10)
      SELECT key, step, CAST(CAST(last + step AS DATE) AS VARCHAR) AS ts, {r('p1', 2, 'y_pred')} FROM walk WHERE step > 0"""


@query("f5_forecast_linear", _recursive_sql("supplier_quotes"))
def f5(spark, d):
    return rounded(fx.dated(fc.forecast_linear(fx.supplier_quotes(spark, d), fx.QUOTE, "sell", WEIGHTS, INTERCEPT, 10)), 2)


def weighted(df):
    """A linear model on three lags, as any model callable would be."""
    total = sum((F.col(f"lag_{k}") * w for k, w in enumerate(WEIGHTS, 1)), F.lit(INTERCEPT))
    return df.withColumn("y_pred", total)


@query("f5_forecast_recursive", _recursive_sql("order_quotes"))
def f5_recursive(spark, d):
    return rounded(fx.dated(fc.forecast_recursive(weighted, fx.order_quotes(spark, d), fx.QUOTE, "sell", 3, 10)), 2)


@query(
    "f6_forecast_direct",
    fx.sql(
        f"""SELECT key, step, CAST(CAST(last + step AS DATE) AS VARCHAR) AS ts, {r('a + b * price', 3, 'y_pred')} FROM latest,
        (SELECT 1 AS step, * FROM l1 UNION ALL SELECT 2, * FROM l2 UNION ALL SELECT 3, * FROM l3)""",
        "order_quotes",
        latest=LATEST.format("order_quotes"),
        **{f"l{h}": _slope_sql("order_quotes", h) for h in (1, 2, 3)},
    ),
)
def f6(spark, d):
    rows = fx.order_quotes(spark, d)
    models = {h: fc.fit_forecaster(rows, fx.QUOTE, ["sell"], "sell", "linear", h, solver="normal") for h in (1, 2, 3)}
    return rounded(fx.dated(fc.forecast_direct(models, rows, fx.QUOTE, ["sell"])), 3)


INTERVALS = "\nUNION ALL ".join(
    f"""SELECT key, {level} AS level, {r(f'price + quantile_cont(e, {(1 - level) / 2})', 4, 'lower')}, {r(f'price + quantile_cont(e, {1 - (1 - level) / 2})', 4, 'upper')},
    {r('stddev_pop(e)', 4, 'std_dev')}, {r('var_pop(e)', 2, 'variance')} FROM (SELECT key, y_true - y_pred AS e FROM predictions) JOIN latest USING (key) GROUP BY key, price"""
    for level in fc.LEVELS
)


@query("f7_f8_intervals", fx.sql(INTERVALS, "predictions", latest=LATEST.format("quotes")))
def f7(spark, d):
    ahead = fc.naive_forecast(fx.quotes(spark, d), fx.QUOTE, "sell", 1).select("key", "y_pred")
    out = fc.interval(ahead, with_errors(fx.predictions(spark, d)), ["key"]).drop("y_pred")
    return rounded(rounded(out, 4, "lower", "upper", "std_dev"), 2, "variance")


SCENARIOS = {
    "rise": {"sell": 0.1},
    "fall": {"sell": {"multiply": 0.9}, "buy": {"add": -5}},
    "other": {"volume": 0.5},
}
SCENARIO_SQL = """SELECT 'rise' AS scenario, key, ts, sell * (1 + 0.1::DOUBLE) AS sell, buy FROM supplier_quotes
  UNION ALL SELECT 'fall', key, ts, sell * 0.9::DOUBLE, buy - 5 FROM supplier_quotes UNION ALL SELECT 'other', key, ts, sell, buy FROM supplier_quotes"""


@query("f9_apply_scenarios", fx.sql(f"SELECT scenario, {STAMP}, sell, buy FROM s", "supplier_quotes", s=SCENARIO_SQL))
def f9(spark, d):
    return fx.dated(fc.apply_scenarios(fx.supplier_quotes(spark, d), SCENARIOS))


@query(
    "f10_f16_scenario_delta",
    fx.sql(
        f"""SELECT scenario, key, {r('y_pred', 4, 'y_pred')}, {r('base', 4, 'base')}, {r('(y_pred - base) / base * 100', 6, 'delta_pct')},
        CASE WHEN (y_pred - base) / base * 100 > 1e-9 THEN 'up' WHEN (y_pred - base) / base * 100 < -1e-9 THEN 'down' ELSE 'flat' END AS impact FROM
        means JOIN (SELECT key, y_pred AS base FROM means WHERE scenario = 'other') USING (key)""",
        "supplier_quotes",
        s=SCENARIO_SQL,
        means="SELECT scenario, key, CAST(sum(CAST(sell AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS y_pred FROM s GROUP BY ALL",
    ),
)
def f10(spark, d):
    rows = fx.supplier_quotes(spark, d)
    mean = F.try_divide(F.sum(F.col("sell").cast("decimal(18,6)")).cast("double"), F.count(F.lit(1)))
    scored = settle(fc.apply_scenarios(rows, SCENARIOS).groupBy("scenario", "key").agg(mean.alias("y_pred")), "scenarios")
    base = scored.where("scenario = 'other'").select("key", "y_pred")
    return rounded(rounded(fc.scenario_delta(scored, base, ["key"]), 4, "y_pred", "base"), 6, "delta_pct")


LAGGED = f"SELECT key, ts, sell, lag(sell, 1) OVER ({SERIES}) AS sell_lag_1, lag(sell, 7) OVER ({SERIES}) AS sell_lag_7 FROM quotes"


def two_lags(df):
    return df.withColumn("y_pred", F.col("sell_lag_1") * 0.7 + F.col("sell_lag_7") * 0.2)


def _rmse(p1: str, p7: str) -> str:
    return f"sqrt(avg(pow(p.sell - (0.7 * {p1}.sell_lag_1 + 0.2 * {p7}.sell_lag_7), 2)))"


@query(
    "f11_permutation_importance",
    fx.sql(
        f"""SELECT 'sell_lag_1' AS feature, {r('r1', 3, 'rmse')}, {r('r1 - r0', 3, 'delta_rmse')} FROM scores
        UNION ALL SELECT 'sell_lag_7', {r('r7', 3, 'rmse')}, {r('r7 - r0', 3, 'delta_rmse')} FROM scores""",
        "quotes",
        lagged=LAGGED,
        placed=f"SELECT *, row_number() OVER ({SERIES}) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM lagged WHERE sell_lag_7 IS NOT NULL",
        scores=f"""SELECT {_rmse('p', 'p')} AS r0, {_rmse('q', 'p')} AS r1, {_rmse('p', 'q')} AS r7
          FROM placed p JOIN placed q ON p.key = q.key AND q.pos = (p.pos * 1000003 + 42) % p.n""",
    ),
)
def f11(spark, d):
    rows = add_features(fx.quotes(spark, d), fx.QUOTE, lags.lags(["sell"], [1, 7])).where("sell_lag_7 is not null")
    return rounded(fc.permutation_importance(two_lags, rows, fx.QUOTE, ["sell_lag_1", "sell_lag_7"], "sell"), 3)


@query(
    "f12_model_importance",
    fx.sql(
        f"SELECT 'sell' AS feature, {r('abs(b) * sd', 3, 'importance')} FROM line, (SELECT stddev_samp(sell) AS sd FROM order_quotes)",
        "order_quotes",
        line=_slope_sql("order_quotes", 1),
    ),
)
def f12(spark, d):
    rows = fx.order_quotes(spark, d)
    model = fc.fit_forecaster(rows, fx.QUOTE, ["sell"], "sell", "linear", solver="normal")
    return rounded(fc.model_importance(model, rows, ["sell"]), 3)


TWO = """SELECT key, arg_max(sell, ts) AS current, arg_min(sell, ts) AS previous FROM
  (SELECT * FROM supplier_quotes QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC) <= 2) GROUP BY key"""
SPREADS = """SELECT key, avg(sell) AS y_pred, stddev_pop(sell) AS std_dev FROM supplier_quotes GROUP BY key"""


@query(
    "f13_signal",
    fx.sql(
        f"""SELECT key, {r('(y_pred - current) / current * 100', 5, 'expected_return')}, CASE WHEN (y_pred - current) / current * 100 > 2 THEN 'Buy'
        WHEN (y_pred - current) / current * 100 < -2 THEN 'Sell' ELSE 'Hold' END AS signal FROM two JOIN spreads USING (key)""",
        "supplier_quotes",
        two=TWO,
        spreads=SPREADS,
    ),
)
def f13(spark, d):
    rows = fx.supplier_quotes(spark, d)
    mean = rows.groupBy("key").agg(F.avg("sell").alias("y_pred"))
    joined = fc.latest_two(rows, fx.QUOTE, "sell").join(mean, "key")
    return rounded(fc.signal(joined).select("key", "expected_return", "signal"), 5)


@query(
    "f14_market_context",
    fx.sql(
        f"""SELECT key, current, previous, {r('(current - previous) / previous * 100', 6, 'recent_change')}, CASE WHEN (current - previous) / previous * 100 > 1 THEN 'Rising'
        WHEN (current - previous) / previous * 100 < -1 THEN 'Declining' ELSE 'Stable' END AS trend FROM two""",
        "supplier_quotes",
        two=TWO,
    ),
)
def f14(spark, d):
    return rounded(fc.market_context(fx.supplier_quotes(spark, d), fx.QUOTE, "sell"), 6, "recent_change")


@query(
    "f15_risk_level",
    fx.sql(
        f"""SELECT key, {r('std_dev', 4, 'std_dev')}, CASE WHEN std_dev / current > 0.05 THEN 'High' WHEN std_dev / current > 0.02 THEN 'Medium' ELSE 'Low' END AS risk
        FROM two JOIN spreads USING (key)""",
        "supplier_quotes",
        two=TWO,
        spreads=SPREADS,
    ),
)
def f15(spark, d):
    rows = fx.supplier_quotes(spark, d)
    spread = rows.groupBy("key").agg(F.stddev_pop("sell").alias("std_dev"))
    joined = fc.latest_two(rows, fx.QUOTE, "sell").join(spread, "key")
    return rounded(fc.risk_level(joined).select("key", "std_dev", "risk"), 4)


# runs

GRID = {"weight": (0.0, 0.25, 0.5, 0.75, 1.0), "damping": (0.9, 1.0)}


def _grid_sql(base: str = "lagged") -> dict[str, str]:
    return {
        "lagged": LAGGED,
        "grid": "SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS weight, damping FROM (SELECT unnest([0.9, 1.0])::DOUBLE AS damping)",
        "scored": f"""SELECT key, weight, damping, sqrt(avg(pow(sell - damping * (weight * sell_lag_1 + (1 - weight) * sell_lag_7), 2))) AS rmse
          FROM {base}, grid WHERE sell_lag_7 IS NOT NULL GROUP BY ALL""",
    }


def _grid_scores(spark, d):
    rows = add_features(fx.quotes(spark, d), fx.QUOTE, lags.lags(["sell"], [1, 7])).where("sell_lag_7 is not null")

    def mix(p):
        return p["damping"] * (p["weight"] * F.col("sell_lag_1") + (1 - p["weight"]) * F.col("sell_lag_7"))

    return runs.score_grid(rows, runs.param_grid(GRID), mix, "sell", ["key"])


@query("e1_grid_scores", fx.sql(f"SELECT key, weight, damping, {r('rmse', 3, 'rmse')} FROM scored", "quotes", **_grid_sql()))
def e1(spark, d):
    return rounded(_grid_scores(spark, d), 3, "rmse")


@query(
    "e2_random_draws",
    fx.sql(
        """SELECT run_id, list_value(16, 32, 64)[(('0x' || md5('42|' || run_id || '|batch')[1:8])::BIGINT % 3) + 1] AS batch,
        list_value(0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE, 0.4::DOUBLE)[(('0x' || md5('42|' || run_id || '|dropout')[1:8])::BIGINT % 4) + 1] AS dropout
        FROM (SELECT DISTINCT run_id FROM history)""",
        "history",
    ),
)
def e2(spark, d):
    trials = fx.history(spark, d).select("run_id").distinct()
    return runs.random_draws(trials, {"batch": [16, 32, 64], "dropout": [0.1, 0.2, 0.3, 0.4]}, "run_id")


@query(
    "e3_best_params",
    fx.sql(
        f"""SELECT key, weight, damping, {r('rmse', 3, 'rmse')} FROM scored QUALIFY row_number() OVER (PARTITION BY key ORDER BY rmse, weight, damping) = 1""",
        "quotes",
        **_grid_sql(),
    ),
)
def e3(spark, d):
    return rounded(runs.best_params(_grid_scores(spark, d), ["key"], ["weight", "damping"]), 3, "rmse")


SETS = [{"lags": [k], "ridge": ridge} for k in (1, 2, 5) for ridge in (0.0, 1e9)]
SEARCH_CTES = {
    "ranked": RANKED.format("order_quotes"),
    "lagged": """SELECT key, sell AS y, CASE WHEN pos < floor(n * 0.8::DOUBLE) THEN 'train' WHEN pos < floor(n * 0.9::DOUBLE) THEN 'validation' END AS part,
      [lag(sell, 1) OVER w, lag(sell, 2) OVER w, lag(sell, 5) OVER w] AS xs FROM ranked WINDOW w AS (PARTITION BY key ORDER BY ts)""",
    "tried": f"""SELECT key, y, part, set, lag, ridge, CASE lag WHEN 1 THEN xs[1] WHEN 2 THEN xs[2] ELSE xs[3] END AS x FROM lagged,
      (VALUES {', '.join(f"({i}, {p['lags'][0]}, {p['ridge']}::DOUBLE)" for i, p in enumerate(SETS))}) v(set, lag, ridge) WHERE xs[3] IS NOT NULL""",
    "fits": """SELECT *, my - w * mx AS b FROM (SELECT key, set, lag, ridge, regr_sxy(y, x) / (regr_sxx(y, x) + any_value(ridge)) AS w, avg(y) AS my, avg(x) AS mx, count(*) AS n_train
      FROM tried WHERE part = 'train' GROUP BY ALL)""",
    "tests": """SELECT key, set, any_value(f.lag) AS lag, any_value(f.ridge) AS ridge, any_value(w) AS weight, any_value(b) AS intercept, any_value(n_train) AS n_train, count(*) AS n_valid,
      sqrt(avg((y - b - w * x) * (y - b - w * x))) AS rmse FROM tried JOIN fits f USING (key, set) WHERE part = 'validation' GROUP BY ALL""",
}
SEARCH_SHOWN = f"key, set, lag, ridge, n_train, n_valid, {r('weight', 6, 'weight')}, {r('intercept', 3, 'intercept')}, {r('rmse', 3, 'rmse')}"


def _searched(spark, d):
    return linear.linear_search(fx.order_quotes(spark, d), fx.QUOTE, "sell", SETS)


def _search_rows(found):
    shown = found.select("key", "set", F.col("lags")[0].alias("lag"), "ridge", "n_train", "n_valid", F.col("weights")[0].alias("weight"), "intercept", "rmse")
    return rounded(rounded(shown, 6, "weight"), 3, "intercept", "rmse")


@query("e1_e3_fitted_sets", fx.sql(f"SELECT {SEARCH_SHOWN} FROM tests", "order_quotes", **SEARCH_CTES))
def e3_sets(spark, d):
    return _search_rows(_searched(spark, d))


@query(
    "e3_fitted_best",
    fx.sql(f"SELECT {SEARCH_SHOWN} FROM tests QUALIFY row_number() OVER (PARTITION BY key ORDER BY rmse, set) = 1", "order_quotes", **SEARCH_CTES),
)
def e3_fitted(spark, d):
    return _search_rows(linear.best_fit(_searched(spark, d), ["key"]))


FITTED_CTES = {
    "ranked": RANKED.format("order_quotes"),
    "rows": "SELECT *, lag(sell) OVER (PARTITION BY key ORDER BY ts) AS x FROM ranked",
    "folds": """SELECT *, CASE WHEN pos < n - (6 - fold) * (n // 6) THEN 'train' WHEN pos < n - (5 - fold) * (n // 6) THEN 'test' END AS part
      FROM rows, (SELECT range AS fold FROM range(1, 6))""",
    "fits": """SELECT key, fold, regr_slope(sell, x) AS w, regr_intercept(sell, x) AS b, count(x) AS n_train FROM folds WHERE part = 'train' GROUP BY ALL""",
    "ahead": "SELECT key, fold, ts, sell AS y_true, b + w * x AS y_pred FROM folds JOIN fits USING (key, fold) WHERE part = 'test'",
}


@query(
    "m18_m19_fitted_folds",
    fx.sql(f"SELECT key, CAST(fold AS INTEGER) AS fold, n_train, {r('w', 6, 'weight')}, {r('b', 3, 'intercept')} FROM fits", "order_quotes", **FITTED_CTES),
)
def m18_fits(spark, d):
    fits, _ = linear.linear_backtest(fx.order_quotes(spark, d), fx.QUOTE, "sell")
    shown = fits.select("key", "fold", "n_train", F.col("weights")[0].alias("weight"), "intercept")
    return rounded(rounded(shown, 6, "weight"), 3, "intercept")


@query(
    "m18_m19_fitted_errors",
    fx.sql(
        f"""SELECT key, CAST(fold AS INTEGER) AS fold, {r('sqrt(avg((y_true - y_pred) * (y_true - y_pred)))', 3, 'rmse')}, {r('avg(abs(y_true - y_pred))', 3, 'mae')},
        {r('avg(abs((y_true - y_pred) / y_true)) * 100', 4, 'mape')} FROM ahead GROUP BY ALL""",
        "order_quotes",
        **FITTED_CTES,
    ),
)
def m18_errors(spark, d):
    _, ahead = linear.linear_backtest(fx.order_quotes(spark, d), fx.QUOTE, "sell")
    scored = fold_metrics(ahead, fx.QUOTE).select("key", "fold", "rmse", "mae", "mape")
    return rounded(rounded(scored, 3, "rmse", "mae"), 4, "mape")


@query(
    "e4_training_summary",
    fx.sql(
        """SELECT run_id, count(*) AS epochs_trained, arg_max(loss, epoch) AS final_loss, arg_max(val_loss, epoch) AS final_val_loss, min(loss) AS best_loss,
        min(val_loss) AS best_val_loss, (SELECT min(epoch) FROM history b WHERE b.run_id = a.run_id AND b.loss = min(a.loss)) AS best_epoch,
        (SELECT min(epoch) FROM history b WHERE b.run_id = a.run_id AND b.val_loss = min(a.val_loss)) AS best_val_epoch,
        count(*) < 80 AS early_stopped FROM history a GROUP BY run_id""",
        "history",
    ),
)
def e4(spark, d):
    return runs.training_summary(fx.history(spark, d), epochs=80)


@query(
    "e5_improvement_rate",
    fx.sql(
        f"""SELECT run_id, {r('coalesce(avg(CASE WHEN val_loss < p THEN (p - val_loss) / p END), 0)', 6, 'improvement_rate')} FROM
        (SELECT *, lag(val_loss) OVER (PARTITION BY run_id ORDER BY epoch) AS p FROM history) GROUP BY run_id""",
        "history",
    ),
)
def e5(spark, d):
    return rounded(runs.improvement_rate(fx.history(spark, d)), 6)


def _stop_sql(delta: float) -> str:
    return fx.sql(
        """SELECT run_id, min(CASE WHEN wait >= 15 THEN epoch END) AS stop_epoch, max(epoch) AS last_epoch FROM walk GROUP BY run_id""",
        "history",
        rows_in="SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS rn FROM history",
        walk=f"""SELECT run_id, epoch, rn, val_loss AS best, 0 AS wait FROM rows_in WHERE rn = 1
          UNION ALL SELECT h.run_id, h.epoch, h.rn, CASE WHEN h.val_loss < w.best - {delta} THEN h.val_loss ELSE w.best END,
          CASE WHEN h.val_loss < w.best - {delta} THEN 0 ELSE w.wait + 1 END FROM walk w JOIN rows_in h ON h.run_id = w.run_id AND h.rn = w.rn + 1""",
    ).replace("WITH ", "WITH RECURSIVE ", 1)


@query("e6_early_stop", _stop_sql(0.0))
def e6(spark, d):
    return runs.early_stop(fx.history(spark, d))


@query("e6_early_stop_min_delta", _stop_sql(400.0))
def e6_delta(spark, d):
    return runs.early_stop(fx.history(spark, d), min_delta=400.0)


@query(
    "e7_best_run",
    fx.sql("SELECT run_id, best_loss FROM (SELECT run_id, min(loss) AS best_loss FROM history GROUP BY run_id) ORDER BY best_loss, run_id LIMIT 1", "history"),
)
def e7(spark, d):
    losses = fx.history(spark, d).groupBy("run_id").agg(F.min("loss").alias("best_loss"))
    return runs.best_run(losses, "best_loss")


@query(
    "e8_compare_runs",
    fx.sql(
        f"""SELECT model || '/' || key AS run_id, {r('rmse', 4, 'rmse')}, {r('mape', 4, 'mape')}, CAST(NULL AS DOUBLE) AS accuracy FROM scores""",
        "models",
        **MODEL_SCORES,
    ),
)
def e8(spark, d):
    scores = metrics(fx.models(spark, d), MODEL, median=False).withColumn("run_id", F.concat_ws("/", "model", "key"))
    log = scores.select(
        "run_id", F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in ("rmse", "mape")]))
    )
    return rounded(runs.compare_runs(log, ["rmse", "mape", "accuracy"]), 4)


@query(
    "e9_expired_runs",
    """SELECT o_orderkey AS run_id, o_orderstatus AS grp, CAST(o_orderdate AS VARCHAR) AS started FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) > 10""",
)
def e9(spark, d):
    from tickloom.sources.readers import read_table

    rows = read_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("grp"), F.col("o_orderdate").alias("started")
    )
    return fx.dated(runs.expired_runs(rows, 10, groups=["grp"]))


@query(
    "e10_top_metrics",
    fx.sql(
        f"""SELECT run_id, metric, {r('value', 4, 'value')}, family FROM (SELECT *, CASE WHEN metric LIKE '%direction%' THEN 'direction'
          WHEN metric IN ('rmse', 'mape', 'mae') THEN 'error' ELSE 'accuracy' END AS family FROM (
          SELECT model || '/' || key AS run_id, rmse, mape, mae, r2, direction_accuracy FROM scores) UNPIVOT (value FOR metric IN (rmse, mape, mae, r2, direction_accuracy)))
        QUALIFY row_number() OVER (PARTITION BY family ORDER BY value DESC, run_id, metric) <= 3""",
        "models",
        **MODEL_SCORES,
    ),
)
def e10(spark, d):
    names = ("rmse", "mape", "mae", "r2", "direction_accuracy")
    scores = metrics(fx.models(spark, d), MODEL, median=False).withColumn("run_id", F.concat_ws("/", "model", "key"))
    log = scores.select("run_id", F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])))
    return rounded(runs.top_metrics(log, 3), 4)
