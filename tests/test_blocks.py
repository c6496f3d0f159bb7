"""Windows over cut series give what pandas gives over whole ones."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import indicators as ind
from tickloom.operators import lags
from tickloom.operators.blocks import Series, add_features, block_layout, numbered, running

SIZES = {"hot": 2500, "small": 40, "one": 1}
BLOCKS = (1_000_000, 700, 37)


def frame():
    rng = np.random.default_rng(1)
    parts = []
    for key, n in SIZES.items():
        sell = 100 + rng.normal(0, 1, n).cumsum() * 0.1
        ts = pd.Timestamp("2020-01-01") + pd.to_timedelta(np.sort(rng.choice(50_000, n, replace=False)), unit="min")
        parts.append(pd.DataFrame({"key": key, "ts": ts, "sell": sell, "buy": sell - 1}))
    return pd.concat(parts, ignore_index=True)


def expected(pdf):
    out = []
    for _, g in pdf.groupby("key"):
        g, p = g.copy(), g["sell"]
        for n in (5, 10, 20, 50):
            g[f"ema_{n}"], g[f"sma_{n}"] = p.ewm(span=n).mean(), p.rolling(n).mean()
        step = p.diff()
        gain, loss = step.where(step > 0, 0).rolling(14).mean(), (-step.where(step < 0, 0)).rolling(14).mean()
        g["rsi"] = 100 - 100 / (1 + gain / loss)
        g["macd"] = p.ewm(span=12).mean() - p.ewm(span=26).mean()
        g["macd_signal"] = g["macd"].ewm(span=9).mean()
        g["bollinger_upper"] = p.rolling(20).mean() + 2 * p.rolling(20).std()
        g["volatility_10"] = p.rolling(10).std()
        g["rolling_max_20"] = p.rolling(20).max()
        low, high = p.rolling(50).min(), p.rolling(50).max()
        g["price_position_50"] = (p - low) / (high - low)
        g["return_7d"] = p.pct_change(7)
        g["sell_lag_30"] = p.shift(30)
        out.append(g)
    return pd.concat(out).sort_values(["key", "ts"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def data(spark):
    pdf = frame()
    return pdf, spark.createDataFrame(pdf.sample(frac=1, random_state=3)), expected(pdf)


@pytest.mark.parametrize("rows", BLOCKS)
def test_features_equal_pandas(data, rows):
    _, df, want = data
    s = Series(("key",), "ts", block_rows=rows)
    made = add_features(df, s, *ind.indicators("sell"), *ind.derived(), lags.lags(["sell"]))
    got = made.toPandas().sort_values(["key", "ts"]).reset_index(drop=True)
    assert len(got) == len(want)
    for c in want.columns.difference(["key", "ts"]):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-7, atol=1e-9, err_msg=c)


@pytest.mark.parametrize("rows", BLOCKS)
def test_running_and_positions(data, rows):
    pdf, df, _ = data
    s = Series(("key",), "ts", block_rows=rows)
    wanted = {"low": ("min", "sell"), "total": ("sum", "sell"), "high": ("max", "sell")}
    got = running(df, s, wanted, pos=True).toPandas().sort_values(["key", "ts"]).reset_index(drop=True)
    pdf = pdf.sort_values(["key", "ts"]).reset_index(drop=True)
    by = pdf.groupby("key")["sell"]
    np.testing.assert_allclose(got["low"], by.cummin())
    np.testing.assert_allclose(got["high"], by.cummax())
    np.testing.assert_allclose(got["total"], by.cumsum())
    assert (got["pos"] == pdf.groupby("key").cumcount()).all()
    counted = numbered(df, s).groupBy("key").agg({"n": "max", "pos": "max"}).toPandas().set_index("key")
    assert counted["max(n)"].to_dict() == SIZES


def test_no_keys(data):
    pdf, df, _ = data
    hot = df.where("key = 'hot'").drop("key")
    got = add_features(hot, Series((), "ts", block_rows=100), ind.sma("sell")).toPandas().sort_values("ts")
    want = pdf[pdf.key == "hot"].sort_values("ts")["sell"].rolling(20).mean()
    np.testing.assert_allclose(got["sma_20"].astype(float), want)


def test_bursts_are_cut_by_row_count(spark):
    """Half of the rows lie in one second of a year; slots are refined until blocks are even."""
    calm = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(1000) * 8, unit="h")
    burst = pd.Timestamp("2024-05-05") + pd.to_timedelta(np.arange(1000) * 777, unit="us")
    ts = np.concatenate([calm, burst])
    df = spark.createDataFrame(pd.DataFrame({"key": "k", "ts": ts, "sell": np.arange(2000.0)}))
    s = Series(("key",), "ts", block_rows=100)
    per_block = block_layout(df, s, 0).cells
    assert per_block.select("_block").distinct().count() >= 10
    got = add_features(df, s, lags.lags(["sell"], [1])).toPandas().sort_values("ts")
    want = pd.DataFrame({"ts": ts, "sell": np.arange(2000.0)}).sort_values("ts")["sell"].shift(1)
    np.testing.assert_allclose(got["sell_lag_1"].astype(float), want)


def test_layout_rows_follow_the_blocks(spark):
    """Half of the rows in two dense seconds of a year, beside a calm series with its own times: cells stay near the number of blocks."""
    calm = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(np.random.default_rng(4).integers(0, 366 * 86400, 30_000)), unit="s")
    burst = pd.Timestamp("2024-05-05") + pd.to_timedelta(np.arange(30_000) * 33, unit="us")
    dense = pd.DataFrame({"key": "k", "ts": np.concatenate([calm, burst])})
    other = pd.DataFrame({"key": "o", "ts": pd.Timestamp("1990-01-01") + pd.to_timedelta(np.arange(5000), unit="s")})
    df = spark.createDataFrame(pd.concat([dense, other])).withColumn("sell", F.unix_micros("ts").cast("double"))
    for keys, rows in ((("key",), df), ((), df.where("key = 'k'").drop("key"))):
        s = Series(keys, "ts", block_rows=1000)
        cells = block_layout(rows, s, 50).cells
        own = cells.where("key = 'k'") if keys else cells
        assert own.count() <= 200
        assert own.select("_block").distinct().count() >= 40
        counted = numbered(rows, s).toPandas().sort_values([*keys, "ts", "pos"])
        assert (counted["pos"] == (counted.groupby("key") if keys else counted.assign(k=1).groupby("k")).cumcount()).all()
        moved = add_features(rows, s, lags.lags(["sell"], [37])).toPandas().sort_values([*keys, "ts", "sell"])
        want = moved.groupby("key")["sell"].shift(37) if keys else moved["sell"].shift(37)
        np.testing.assert_allclose(moved["sell_lag_37"].astype(float), want)
    laid = add_features(df, Series(("key",), "ts", block_rows=1000), lags.lags(["sell"], [1]))
    assert laid.count() == 65_000


def test_rows_without_a_time_come_first(spark):
    rows = [("a", None, 1.0)] * 3 + [("a", i, float(i)) for i in range(500)]
    df = spark.createDataFrame(rows, "key string, ts int, sell double")
    got = numbered(df, Series(("key",), "ts", block_rows=40)).where("ts is not null").toPandas()
    assert (got["pos"] == got["ts"] + 3).all()


def test_one_shuffle_and_no_single_partition(data):
    _, df, _ = data
    made = add_features(df, Series(("key",), "ts"), *ind.indicators("sell"), *ind.derived())
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_ema_skips_gaps_like_pandas(spark):
    x = pd.Series([1.0, None, 3.0, 4.0, None, 6.0])
    df = spark.createDataFrame([("a", i, None if pd.isna(v) else float(v)) for i, v in enumerate(x)], "key string, ts int, sell double")
    got = add_features(df, Series(("key",), "ts"), ind.ema("sell", (3,))).toPandas().sort_values("ts")
    np.testing.assert_allclose(got["ema_3"].astype(float), x.ewm(span=3).mean())


@pytest.mark.parametrize("rows", (1_000_000, 700, 37))
def test_ema_of_any_span_over_any_gap(spark, rows):
    rng = np.random.default_rng(2)
    n = 5000
    x = pd.Series(50 + rng.normal(0, 1, n).cumsum())
    at = np.arange(n)
    x[(at % 460 >= 60) | ((at > 1500) & (at < 4700) & (at != 3000)) | (at < 3)] = np.nan
    df = spark.createDataFrame([("a", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)] + [("b", 0, 1.0), ("c", 0, None), (None, 5, 2.0)], "key string, ts int, sell double")
    got = add_features(df, Series(("key",), "ts", block_rows=rows), ind.ema("sell", (1, 2, 5, 100, 200, 5000)), ind.macd("sell")).toPandas()
    a = got[got.key == "a"].sort_values("ts")
    for span in (2, 5, 100, 200, 5000):
        want = x.ewm(span=span).mean()
        held = want.copy()
        # where every weight of a span has left the range of a double, the mean still stands
        assert a[f"ema_{span}"].isna().sum() == 3
        near = (at < 1500) | (at > 4700)
        np.testing.assert_allclose(a[f"ema_{span}"].astype(float)[near], held[near], rtol=1e-9, err_msg=str(span))
        assert np.isfinite(a[f"ema_{span}"].astype(float)[3:]).all()
    np.testing.assert_allclose(a["ema_1"].astype(float), x.ffill())
    assert got[got.key == "b"]["ema_5"].tolist() == [1.0] and got[got.key == "c"]["ema_5"].isna().all() and got[got.key.isna()]["ema_200"].tolist() == [2.0]
    macd = x.ewm(span=12).mean() - x.ewm(span=26).mean()
    near = at < 1500
    np.testing.assert_allclose(a["macd_signal"].astype(float)[near], macd.ewm(span=9).mean()[near], rtol=1e-6, atol=1e-9)
    with pytest.raises(ValueError):
        ind.ema("sell", (0,))


def test_indicators_of_far_apart_periods(spark):
    x = pd.Series(np.arange(700.0) % 13)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "ts int, sell double")
    got = add_features(df, Series((), "ts", block_rows=150), *ind.indicators("sell", (5, 100, 200))).toPandas().sort_values("ts")
    for n in (5, 100, 200):
        np.testing.assert_allclose(got[f"ema_{n}"].astype(float), x.ewm(span=n).mean(), rtol=1e-9)
        np.testing.assert_allclose(got[f"sma_{n}"].astype(float), x.rolling(n).mean(), rtol=1e-9)


def test_flat_and_short_series(spark):
    flat = [("flat", i, 5.0) for i in range(60)] + [("short", i, float(i)) for i in range(3)]
    rising = [("rise", i, float(i)) for i in range(20)]
    df = spark.createDataFrame(flat + rising, "key string, ts int, sell double")
    got = add_features(df, Series(("key",), "ts"), ind.rsi("sell"), ind.price_position("sell"), ind.sma("sell")).toPandas()
    assert got[got.key == "flat"]["rsi"].isna().all()
    assert got[got.key == "flat"]["price_position_10"].isna().all()
    assert got[got.key == "short"][["sma_5", "rsi"]].isna().all().all()
    rise = got[got.key == "rise"].sort_values("ts")["rsi"]
    assert rise.isna().tolist() == [True] * 13 + [False] * 7 and (rise.dropna() == 100).all()
