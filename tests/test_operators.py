"""Edge cases with hand-computed or brute-force answers."""
import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions.columns import normal_quantile, pct_change_or_zero
from tickloom.operators import cleaning, explore, forecast, linear, metrics, monitor, quality, residuals, runs, scaling, sequences
from tickloom.operators.blocks import Series
from tickloom.operators.quantiles import quantiles
from tickloom.sources import readers, writers
from tickloom.sources.session import new_path, shared_dir

S = Series(("key",), "ts")
SHAPE = "key string, ts int, x double"


def series(spark, values, key="a"):
    return spark.createDataFrame([(key, i, v) for i, v in enumerate(values)], SHAPE)


def column(df, name, order="ts"):
    return [r[name] for r in df.orderBy(order).collect()]


@pytest.mark.parametrize("accuracy", [10_000, 60, 25])
def test_quantiles_are_exact_through_every_path(spark, accuracy):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"key": ["hot"] * 3000 + ["cold"] * 7, "x": np.round(rng.lognormal(0, 2, 3007), 2)})
    pdf.loc[:1000, "x"] = 1.25  # a third of the rows share one value
    df = spark.createDataFrame(pdf).union(spark.createDataFrame([("void", None)], "key string, x double"))
    shares = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q99": 0.99, "q100": 1.0}
    got = quantiles(df, ["key"], {n: ("x", p) for n, p in shares.items()}, accuracy=accuracy).toPandas().set_index("key")
    for key, g in pdf.groupby("key"):
        for name, p in shares.items():
            assert got.loc[key, name] == pytest.approx(g["x"].quantile(p), abs=1e-12)
    assert got.loc["void"].isna().all()
    whole = quantiles(df, [], {"m": ("x", 0.5)}, accuracy=accuracy).first().m
    assert whole == pytest.approx(pdf["x"].median())


@pytest.mark.parametrize("rows", [1_000_000, 3])
def test_fills(spark, rows):
    values = [None, 1.0, None, None, 4.0, 5.0, None]
    df, s = series(spark, values), S.with_rows(rows)
    p = pd.Series(values, dtype=float)
    for strategy, want in {
        "forward_fill": p.ffill(),
        "backward_fill": p.bfill(),
        "interpolate": p.interpolate(),
        "mean": p.fillna(p.mean()),
        "median": p.fillna(p.median()),
    }.items():
        got = pd.Series(column(cleaning.fill(df, s, ["x"], strategy), "x"), dtype=float)
        pd.testing.assert_series_equal(got, want, check_names=False)
    assert cleaning.fill(df, s, ["x"], "drop").count() == 3
    with pytest.raises(ValueError):
        cleaning.fill(df, s, ["x"], "guess")


def test_fill_of_a_key_with_nulls_only(spark):
    df = series(spark, [None, None])
    for strategy in ("forward_fill", "interpolate", "mean", "median"):
        assert column(cleaning.fill(df, S, ["x"], strategy), "x") == [None, None]


def test_dedup_keeps_the_last_by_tie(spark):
    df = spark.createDataFrame([("a", "2", 1, 5.0), ("a", "1", 1, 4.0), ("a", "3", 2, None)], "key string, id string, ts int, x double")
    got = cleaning.dedup_last(df, Series(("key",), "ts", ("id",))).orderBy("ts").collect()
    assert [(r.id, r.x) for r in got] == [("2", 5.0), ("3", None)]


def test_outliers_are_replaced(spark):
    values = [10.0, 11.0, 9.0, 1000.0, 10.0, 12.0, 11.0]
    assert column(cleaning.replace_outliers(series(spark, values), S, ["x"]), "x")[3] == 9.5
    forest = cleaning.flag_outliers(series(spark, values * 5), ["key"], ["x"], "isolation_forest")
    assert {r.x for r in forest.where("x_outlier").collect()} <= {1000.0, 9.0, 12.0}
    with pytest.raises(ValueError):
        cleaning.flag_outliers(series(spark, values), ["key"], ["x"], "guess")


def test_clean_dirty_text(spark):
    rows = [("a", str(i), f"2024-01-{i + 1:02d} 00:00:00", str(100 + i), str(99 + i)) for i in range(20)]
    rows[4] = ("a", "4", rows[4][2], "n/a", None)
    rows[9] = ("a", "9", rows[9][2], "5000000", "108")
    rows += [("a", "99", rows[3][2], "103.5", "102"), ("a", "98", "never", "1", "1")]
    df = spark.createDataFrame(rows, "key string, id string, ts string, sell string, buy string")
    failed = quality.validate(df, ["sell", "buy"], "ts", ["key"]).where("not ok").collect()
    assert {r.check: r.n_bad for r in failed} == {"date_format": 1, "unique_dates": 1, "numeric_sell": 1}
    with pytest.raises(ValueError, match="date_format"):
        quality.require_valid(df, ["sell", "buy"], "ts", ["key"])
    got = cleaning.clean(df, Series(("key",), "ts", ("id",)), ["sell", "buy"]).orderBy("ts").collect()
    assert len(got) == 20 and got[3].sell == 103.5 and got[4].sell == 103.5 and got[9].sell == 109.0


def test_validate_reports_missing_columns_and_empty_input(spark):
    empty = spark.createDataFrame([], "ts string, sell string")
    got = {r.check: r for r in quality.validate(empty, ["sell", "buy"], "ts").collect()}
    assert got["required_columns"].detail == "buy" and not got["not_empty"].ok
    with pytest.raises(ValueError):
        cleaning.drop_incomplete(series(spark, [None]), check=True)


def test_pct_change_on_a_zero_base(spark):
    df = spark.createDataFrame([(0.0, 5.0), (4.0, 5.0)], "a double, b double")
    assert [r[0] for r in df.select(pct_change_or_zero("a", "b")).collect()] == [0.0, 25.0]


def predictions(spark, y, p):
    return spark.createDataFrame([("a", i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "key string, ts int, y_true double, y_pred double")


@pytest.mark.parametrize("rows", [1_000_000, 2])
def test_metrics_on_five_points(spark, rows):
    y, p = np.array([100, 200, 150, 300, 250.0]), np.array([95, 210, 140, 295, 260.0])
    m = metrics.metrics(predictions(spark, y, p), S.with_rows(rows)).first()
    e = y - p
    assert m.mse == pytest.approx((e**2).mean()) and m.mae == pytest.approx(8.0)
    assert m.mape == pytest.approx((abs(e) / y).mean() * 100)
    assert m.smape == pytest.approx((abs(e) / ((y + p) / 2)).mean() * 100)
    assert m.r2 == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum())
    assert m.direction_accuracy == 100.0 and m.median_absolute_error == 10.0 and m.max_error == 10.0
    assert m.theil_u == pytest.approx(math.sqrt((e**2).mean() / (np.diff(y) ** 2).mean()))


def test_metrics_at_the_edges(spark):
    zero = metrics.metrics(predictions(spark, [0, 100, 200], [5, 95, 205]), S).first()
    assert zero.mape == pytest.approx((5 / 100 + 5 / 200) / 2 * 100)
    perfect = metrics.metrics(predictions(spark, [100, 200, 300], [100, 200, 300]), S).first()
    assert perfect.mse == 0 and perfect.r2 == 1 and perfect.explained_variance == 1
    single = metrics.metrics(predictions(spark, [1], [2]), S).first()
    assert single.direction_accuracy == 0 and single.theil_u is None and single.r2 == 0
    all_zero = metrics.metrics(predictions(spark, [0, 0], [1, 1]), S).first()
    assert all_zero.mape is None and all_zero.relative_rmse is None


def test_bootstrap_brackets_the_metric(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(100, 10, 400)
    df = predictions(spark, y, y + rng.normal(0, 2, 400))
    rmse = metrics.metrics(df, S, median=False).first().rmse
    got = {r.metric: r for r in metrics.bootstrap(df, S, 200).collect()}
    assert got["rmse"].lower < rmse < got["rmse"].upper
    assert got["rmse"].mean == pytest.approx(rmse, rel=0.02)
    assert got["rmse"].std == pytest.approx(rmse / math.sqrt(2 * 400), rel=0.35)


def test_class_labels_and_advice(spark):
    shape = "mape double, r2 double, direction_accuracy double"
    got = residuals.classify(spark.createDataFrame([(0.5, 0.95, 75.0), (1.5, 0.95, 65.0), (20.0, None, 10.0)], shape)).collect()
    assert [r.overall for r in got] == ["Excellent", "Good", "Poor"]
    facts = shape + ", jarque_bera_p double, dagostino_p double, bp_correlation double, durbin_watson double, z_pct double"
    good = spark.createDataFrame([(0.5, 0.95, 75.0, 0.5, 0.5, 0.0, 2.0, 0.0), (6.0, 0.5, 40.0, 0.0, 0.0, 0.9, 0.1, 9.0)], facts)
    texts = [r.recommendations for r in residuals.recommend(good).collect()]
    assert texts[0] == [residuals.ADVICE["fine"]] and len(texts[1]) == 7


def brute_shapiro(x):
    from statistics import NormalDist

    x, n = np.sort(x), len(x)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, mm = 1 / math.sqrt(n), (m**2).sum()
    a = np.zeros(n)
    a[-1] = np.polyval(residuals._LAST, u) + m[-1] / math.sqrt(mm)
    a[-2] = np.polyval(residuals._NEXT, u) + m[-2] / math.sqrt(mm)
    phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a[-1] ** 2 - 2 * a[-2] ** 2)
    a[2:-2] = m[2:-2] / math.sqrt(phi)
    a[0], a[1] = -a[-1], -a[-2]
    return (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()


@pytest.mark.parametrize("rows", [1_000_000, 30])
def test_shapiro_and_qq_against_brute_force(spark, rows):
    x = np.random.default_rng(2).exponential(1, 200)
    df, s = predictions(spark, x, np.zeros(200)), S.with_rows(rows)
    got = residuals.shapiro_wilk(df, s).first()
    assert got.w == pytest.approx(brute_shapiro(x), abs=1e-7) and got.p_value < 1e-6
    points = explore.qq_points(residuals.with_errors(df), s, "error").orderBy("position").toPandas()
    np.testing.assert_allclose(points["value"], np.sort(x))
    assert points["quantile"].is_monotonic_increasing and abs(points["quantile"].sum()) < 1e-6


def few_shapiro(x):
    """W and p of 3 to 11 values, step by step."""
    from statistics import NormalDist

    x, n, normal = np.sort(np.asarray(x, float)), len(x), NormalDist()
    m = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u = 1 / np.sqrt(n)
    last = m[-1] / np.sqrt(m @ m) + np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0], u)
    a = np.empty(n)
    if n == 3:
        a[:] = [-np.sqrt(0.5), 0, np.sqrt(0.5)]
    elif n <= 5:
        a[:] = m / np.sqrt((m @ m - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a[0], a[-1] = -last, last
    else:
        second = m[-2] / np.sqrt(m @ m) + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0], u)
        a[:] = m / np.sqrt((m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2))
        a[0], a[1], a[-2], a[-1] = -last, -second, second, last
    w = (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()
    if n == 3:
        return w, 6 / np.pi * (np.arcsin(np.sqrt(w)) - np.arcsin(np.sqrt(0.75)))
    z = -np.log(0.459 * n - 2.273 - np.log(1 - w)) - np.polyval([-6.714e-4, 0.025054, -0.39978, 0.5440], n)
    return w, 1 - normal.cdf(z / np.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n)))


def test_shapiro_of_few_rows(spark):
    rng = np.random.default_rng(6)
    made = {f"{kind}{n}": draw for n in range(3, 12) for kind, draw in (("normal", rng.normal(0, 1, n)), ("skewed", rng.exponential(1, n) ** 3))}
    made |= {"one": [1.0], "two": [1.0, 2.0], "flat": [4.0] * 5, "even": [1.0, 2.0, 3.0]}
    made |= {f"draw{i}": rng.normal(5, 2, 8) for i in range(1500)}
    rows = [(k, i, float(v), 0.0) for k, x in made.items() for i, v in enumerate(x)]
    got = {r.key: r for r in residuals.shapiro_wilk(spark.createDataFrame(rows, "key string, ts int, y_true double, y_pred double"), S).collect()}
    assert set(got) == set(made)
    for k, x in made.items():
        if k in ("one", "two", "flat"):
            assert got[k].w is None and got[k].p_value is None
        elif not k.startswith("draw") and k != "even":
            w, p = few_shapiro(x)
            assert got[k].w == pytest.approx(w, abs=1e-7) and got[k].p_value == pytest.approx(p, abs=1e-6)
    assert got["even"].w == pytest.approx(1.0) and got["even"].p_value == pytest.approx(1.0, abs=1e-6)
    # p is even over normal samples
    low = np.mean([got[k].p_value < 0.1 for k in made if k.startswith("draw")])
    assert 0.07 < low < 0.13


def test_normal_quantile(spark):
    from statistics import NormalDist

    ps = [1e-6, 0.01, 0.3, 0.5, 0.77, 0.99, 1 - 1e-6]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(normal_quantile(F.col("p"))).collect()]
    np.testing.assert_allclose(got, [NormalDist().inv_cdf(p) for p in ps], rtol=1e-8, atol=1e-9)


def test_ramp_sequences(spark):
    rows = [("a", i, float(i), 100.0 + i, 200.0 + i) for i in range(100)]
    df = spark.createDataFrame(rows, "key string, ts int, value double, f1 double, f2 double")
    got = sequences.make_sequences(df, S.with_rows(25), ["value", "f1", "f2"], "value", 10).orderBy("start").collect()
    assert len(got) == 90 and got[0].target == 10.0
    assert [x.value for x in got[0].features] == [float(i) for i in range(10)]
    thin = sequences.make_sequences(df, S, ["value"], "value", 10, 3, stride=5).orderBy("start").collect()
    assert [r.start for r in thin] == list(range(0, 88, 5)) and thin[0].target == [10.0, 11.0, 12.0]


def test_split_and_folds(spark):
    df = series(spark, [float(i) for i in range(100)])
    split = sequences.split_by_time(df, S.with_rows(9)).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"train": 80, "validation": 10, "test": 10}
    with pytest.raises(ValueError):
        sequences.split_by_time(df, S, 0.5, 0.1, 0.1)
    walked = sequences.walk_forward(df, S, 50, 10, 10).where("part = 'test'").groupBy("fold").agg(F.min("ts").alias("t")).orderBy("fold")
    # 50 + 40 + 10 is not below 100, so the last feasible fold is left out
    assert [r.t for r in walked.collect()] == [50, 60, 70, 80]
    folds = sequences.kfold(df, ["key", "ts"]).groupBy("fold").count().collect()
    assert len(folds) == 5 and sum(r["count"] for r in folds) == 100


def test_scalers_keep_constant_columns_and_invert(spark):
    df = spark.createDataFrame([("a", i, float(i), 7.0) for i in range(10)], "key string, ts int, x double, c double")
    for kind in ("minmax", "standard", "robust"):
        fitted = scaling.fit_scaler(df, ["x", "c"], kind, ["key"])
        scaled = fitted.transform(df)
        assert {r.c for r in scaled.collect()} == {0.0}
        np.testing.assert_allclose(column(fitted.inverse(scaled, "x", "x"), "x"), range(10), atol=1e-12)
    whole = scaling.fit_scaler(df, ["x"], "minmax", [])
    assert column(whole.transform(df), "x")[-1] == 1.0


def test_histogram_of_one_value_and_box(spark):
    bins = explore.histogram(series(spark, [5.0, 5.0]), ["key"], "x", 3).orderBy("bin").collect()
    assert [r["count"] for r in bins] == [2, 0, 0]
    box = explore.box_stats(series(spark, [1.0, 2.0, 3.0, 4.0, 50.0]), ["key"], "x").first()
    assert (box.whisker_low, box.whisker_high, box.fliers) == (1.0, 4.0, 1)


def test_permutation_is_one_to_one(spark):
    df = spark.createDataFrame([("a", i, float(i), float(i)) for i in range(50)], "key string, ts int, f double, y double")
    model = lambda d: d.withColumn("y_pred", F.col("f"))
    got = forecast.permutation_importance(model, df, S, ["f"], "y").first()
    assert got.rmse > 0 and got.delta_rmse == got.rmse


def test_recursive_forms_agree(spark):
    df = spark.createDataFrame([("a", f"2024-01-{i + 1:02d}", float(i * i)) for i in range(9)], "key string, ts string, x double")
    df = df.withColumn("ts", F.to_date("ts"))
    model = lambda d: d.withColumn("y_pred", F.col("lag_1") * 0.6 + F.col("lag_2") * 0.4 + 1)
    a = forecast.forecast_linear(df, S, "x", [0.6, 0.4], 1.0, 4).orderBy("step").collect()
    b = forecast.forecast_recursive(model, df, S, "x", 2, 4).orderBy("step").collect()
    assert [(r.step, str(r.ts)) for r in a] == [(i, f"2024-01-{9 + i:02d}") for i in range(1, 5)]
    np.testing.assert_allclose([r.y_pred for r in a], [r.y_pred for r in b])


def test_hold_and_counter_reset(spark):
    rows = [("a", f"2024-01-01 00:0{i}:00", b, v) for i, (b, v) in enumerate([(True, 5.0), (True, 9.0), (True, 2.0), (False, 3.0), (True, 3.0)])]
    df = spark.createDataFrame(rows, "key string, ts string, breached boolean, value double").withColumn("ts", F.to_timestamp("ts"))
    for limit in (1_000_000, 2):
        held = monitor.hold(df, S.with_rows(limit), hold_s=120)
        assert column(held, "firing") == [False, False, True, False, False]
        assert column(monitor.counter_increase(df, S.with_rows(limit)), "increase") == [None, 4.0, 2.0, 1.0, 0.0]


def test_best_search(spark):
    best, score, tried = runs.search(runs.param_grid({"a": [1, 2], "b": [3, 5]}), lambda a, b: (a - 2) ** 2 + (b - 5) ** 2)
    assert best == {"a": 2, "b": 5} and score == 0 and len(tried) == 4


def test_raw_json_array_and_sinks(spark):
    path = new_path(spark, "array")
    text = '[{"id":"1","hargaJual":"10","hargaBeli":"9","lastUpdate":"2024-01-01 00:00:00"},{"id":"2","hargaJual":"x","hargaBeli":"9","lastUpdate":"2024-01-02 00:00:00"}]'
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    raw = readers.read_quotes(spark, path)
    assert raw.count() == 2 and set(raw.columns) == {"id", "hargaJual", "hargaBeli", "lastUpdate"}
    typed = cleaning.parse_types(raw, "lastUpdate", ["hargaJual", "hargaBeli"])
    assert column(typed, "hargaJual", "id") == [10.0, None]
    with pytest.raises(ValueError):
        readers.read_quotes(spark, path, "xml")
    with pytest.raises(ValueError):
        writers.write_features(raw, path, "xml")


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


@pytest.mark.parametrize("sorted_values, cells", [(20_000, 1024), (50, 8), (1, 2)])
def test_quantiles_are_narrowed_to_what_a_task_sorts(spark, monkeypatch, sorted_values, cells):
    from tickloom.operators import quantiles as q

    monkeypatch.setattr(q, "SORTED_VALUES", sorted_values)
    monkeypatch.setattr(q, "CELLS", cells)
    rng = np.random.default_rng(7)
    parts = {
        "smooth": rng.normal(0, 1e6, 30_000),
        "ties": rng.choice([1.0, 2.0], 25_000),
        "far": np.concatenate([rng.normal(0, 1e-9, 15_000), [1e12, -1e12]]),
        "flat": np.full(12_000, 3.5),
        "short": rng.normal(0, 1, 57),
        "none": np.array([np.nan, np.nan]),
    }
    pdf = pd.concat([pd.DataFrame({"key": k, "x": v, "y": v[::-1] * 2}) for k, v in parts.items()])
    df = spark.createDataFrame(pdf.astype({"key": object})).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in "xy"})
    wanted = {"lo": ("x", 0.0), "q1": ("x", 0.25), "mid": ("x", 0.5), "y9": ("y", 0.9), "hi": ("y", 1.0)}
    got = q.quantiles(df, ["key"], wanted).toPandas().set_index("key")
    assert sorted(got.index) == sorted(parts)
    for name, (c, p) in wanted.items():
        for k, v in parts.items():
            want = np.nan if k == "none" else np.quantile(v if c == "x" else v * 2, p)
            np.testing.assert_allclose(float(got.loc[k, name]), want, rtol=1e-12, atol=1e-21, err_msg=f"{name} {k}")
    whole = q.quantiles(df.where("key <> 'far'"), [], wanted).toPandas().iloc[0]
    pooled = np.concatenate([v for k, v in parts.items() if k not in ("far", "none")])
    for name, (c, p) in wanted.items():
        np.testing.assert_allclose(whole[name], np.quantile(pooled if c == "x" else pooled * 2, p), rtol=1e-12)


def test_no_task_sorts_more_than_its_bound_of_many_distinct_values(spark, monkeypatch):
    """Ten million distinct values: what is collected for a rank stays under the bound."""
    from tickloom.operators import quantiles as q

    seen = []
    plain = q.settle

    def watched(df, label):
        out = plain(df, label)
        if label == "rank-cells":
            seen.append(out.where("_lo < _hi").agg(F.max("_c")).first()[0] or 0)
        return out

    monkeypatch.setattr(q, "settle", watched)
    monkeypatch.setattr(q, "SORTED_VALUES", 500)
    df = spark.range(10_000_000, numPartitions=16).select(((F.col("id") * 7_368_787) % 10_000_019).cast("double").alias("x"))
    got = q.quantiles(df, [], {"a": ("x", 0.5), "b": ("x", 0.99)}).first()
    values = (np.arange(10_000_000, dtype=np.int64) * 7_368_787) % 10_000_019
    assert seen[-1] <= 500 and (got.a, got.b) == (np.quantile(values, 0.5), np.quantile(values, 0.99))


def lag_table(x, lags):
    x = np.asarray(x, float)
    return np.column_stack([np.ones(len(x)), *[np.r_[np.full(k, np.nan), x[:-k]] for k in lags]]), x


def test_fits_of_several_lags_equal_least_squares(spark):
    rng = np.random.default_rng(3)
    x = 1e4 + rng.normal(0, 1, 300).cumsum()
    x[40] = np.nan
    df = series(spark, [None if np.isnan(v) else float(v) for v in x]).unionByName(series(spark, [1.0, 2.0, 3.0], "short")).unionByName(series(spark, [5.0] * 60, "flat"))
    sets = [{"lags": [1]}, {"lags": [1, 2, 7]}, {"lags": [2], "ridge": 50.0}]
    got = {(r.key, r.set): r for r in linear.linear_search(df, Series(("key",), "ts", block_rows=70), "x", sets).collect()}
    assert len(got) == 9
    whole, y = lag_table(x, (1, 2, 7))
    use = ~np.isnan(whole).any(axis=1) & ~np.isnan(y)
    at = np.arange(300)
    train, valid = use & (at < 240), use & (at >= 240) & (at < 270)
    for i, p in enumerate(sets):
        a, t = lag_table(x, p["lags"])
        mean = np.nanmean(x)
        c = np.column_stack([a[:, 0], a[:, 1:] - mean])
        w = np.linalg.solve(c[train].T @ c[train] + np.diag([0] + [p.get("ridge", 0.0)] * len(p["lags"])), c[train].T @ (t[train] - mean))
        r = got["a", i]
        np.testing.assert_allclose(r.weights, w[1:], rtol=1e-6)
        np.testing.assert_allclose(r.rmse, np.sqrt(np.mean((t[valid] - mean - c[valid] @ w) ** 2)), rtol=1e-6)
        np.testing.assert_allclose(r.intercept, w[0] + mean * (1 - w[1:].sum()), rtol=1e-5, atol=1e-4)
        assert (r.n_train, r.n_valid) == (train.sum(), valid.sum())
        assert got["short", i].weights is None and got["short", i].rmse is None
        assert got["flat", i].rmse == pytest.approx(0.0, abs=1e-9)
    best = {r.key: r for r in linear.best_fit(linear.linear_search(df, S, "x", sets), ["key"]).collect()}
    assert best["a"].rmse == min(got["a", i].rmse for i in range(3)) and set(best) == {"a", "flat"}


def test_backtests_fit_every_fold(spark):
    rng = np.random.default_rng(9)
    x = 50 + rng.normal(0, 1, 100).cumsum()
    df = series(spark, [float(v) for v in x]).unionByName(series(spark, [1.0, 2.0], "short"))
    fits, ahead = linear.linear_backtest(df, Series(("key",), "ts", block_rows=30), "x", (1, 2), folds=4)
    a, y = lag_table(x, (1, 2))
    got, seen = {r.fold: r for r in fits.collect()}, {(r.fold, r.ts): r for r in ahead.collect()}
    assert sorted(got) == [1, 2, 3, 4] and len(seen) == 80
    for f in range(1, 5):
        first = 100 - 20 * (5 - f)
        w = np.linalg.lstsq(a[2:first], y[2:first], rcond=None)[0]
        np.testing.assert_allclose([got[f].intercept, *got[f].weights], w, rtol=1e-6)
        assert got[f].n_train == first - 2
        for t in range(first, first + 20):
            np.testing.assert_allclose(seen[f, t].y_pred, a[t] @ w, rtol=1e-9)


def test_bucket_quantiles_with_resets_and_idle_windows(spark):
    rows = [("a", le, t, v) for t, counts in ((0, (0, 0, 0)), (10, (4, 8, 10)), (20, (1, 1, 2)), (320, (1, 1, 2)), (620, (1, 1, 9))) for le, v in zip((1.0, 2.0, float("inf")), counts, strict=True)]
    df = spark.createDataFrame([(k, le, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t), float(v)) for k, le, t, v in rows], "key string, le double, ts timestamp, value double")
    got = {r.start.minute: (r.p50, r.p95) for r in monitor.bucket_quantiles(df, S, {"p50": 0.5, "p95": 0.95}).collect()}
    # increases 5, 9, 12 after the reset; none; then all beyond the last bound
    assert got == {0: (1 + 1 / 4, 2.0), 5: (None, None), 10: (2.0, 2.0)}


def test_rules_take_known_comparisons_only(spark):
    df = spark.createDataFrame([("m", 1.0), ("m", None)], "metric string, value double")
    rules = [("a", "m", op, 1.0, 0, "info") for op in monitor.COMPARISONS]
    got = {(r.op, r.value): r.breached for r in monitor.evaluate_rules(df, rules).collect()}
    assert [got[op, 1.0] for op in ("==", "!=", ">", "<", ">=", "<=")] == [True, False, False, False, True, True]
    assert all(got[op, None] is None for op in monitor.COMPARISONS)
    with pytest.raises(ValueError):
        monitor.evaluate_rules(df, [("a", "m", "=~", 1.0, 0, "info")])


def test_boosted_trees_learn_steps_that_lines_cannot(spark):
    """The next value is a step function of this one; a tree finds the step, a line does not."""
    x = [0.0]
    for _ in range(399):
        x.append((x[-1] + 37) % 100 if x[-1] < 50 else (x[-1] * 0.5 + 3) % 100)
    df = series(spark, x)
    errors = {}
    for algo, settings in (("gbt", {"maxIter": 20, "maxDepth": 4, "seed": 1}), ("linear", {"solver": "normal"})):
        model = forecast.fit_forecaster(df, S, ["x"], "x", algo, **settings)
        ahead = {r.ts: r.y_pred for r in forecast.predict(model, df, ["x"]).collect()}
        errors[algo] = np.mean([abs(ahead[i] - x[i + 1]) for i in range(399)])
        assert forecast.predict_next(model, df, S, ["x"]).first().y_pred == pytest.approx(ahead[399])
    assert errors["gbt"] < 0.2 * errors["linear"] and errors["gbt"] < 2.0
    with pytest.raises(ValueError):
        forecast.fit_forecaster(df, S, ["x"], "x", "net")
