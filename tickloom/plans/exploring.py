"""Queries: exploration."""
from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.columns import rounded
from tickloom.operators import explore, indicators
from tickloom.operators.blocks import add_features
from tickloom.plans import fixtures as fx
from tickloom.plans.features import SERIES, STAMP
from tickloom.plans.registry import query, r
from tickloom.sources.readers import read_table

BOTH = ["sell", "buy"]


def _both(text: str) -> str:
    return "\nUNION ALL ".join(text.replace("{c}", c) for c in BOTH)


@query(
    "a1_describe",
    _both(
        f"""SELECT l_returnflag AS key, 'l_{{c}}' AS "column", count(l_{{c}}) AS count, {r('avg(l_{c})', 4, 'mean')}, {r('stddev_samp(l_{c})', 4, 'std')},
        min(l_{{c}}) AS min, {r('quantile_cont(l_{c}, 0.25)', 4, 'q25')}, {r('quantile_cont(l_{c}, 0.5)', 4, 'q50')}, {r('quantile_cont(l_{c}, 0.75)', 4, 'q75')},
        max(l_{{c}}) AS max FROM lineitem GROUP BY ALL"""
    ).replace("l_sell", "l_quantity").replace("l_buy", "l_extendedprice"),
)
def a1(spark, d):
    rows = read_table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "key")
    return rounded(explore.describe(rows, ["key"], ["l_quantity", "l_extendedprice"]), 4)


@query(
    "a2_price_stats",
    fx.sql(
        _both(f"SELECT key, '{{c}}' AS \"column\", {r('avg({c})', 4, 'mean')}, {r('stddev_samp({c})', 4, 'std')}, {r('stddev_samp({c}) / avg({c}) * 100', 6, 'cv_pct')} FROM quotes GROUP BY key"),
        "quotes",
    ),
)
def a2(spark, d):
    return rounded(rounded(explore.price_stats(fx.quotes(spark, d), ["key"], BOTH), 4, "mean", "std"), 6, "cv_pct")


@query(
    "a3_spread_stats",
    fx.sql(
        f"""SELECT key, {r('avg(sell - buy)', 4, 'mean')}, {r('min(sell - buy)', 4, 'min')}, {r('max(sell - buy)', 4, 'max')},
        {r('avg((sell - buy) / nullif(buy, 0) * 100)', 4, 'mean_pct')} FROM supplier_quotes GROUP BY key""",
        "supplier_quotes",
    ),
)
def a3(spark, d):
    return rounded(explore.spread_stats(fx.supplier_quotes(spark, d), ["key"]), 4)


@query(
    "a4_monthly",
    fx.sql(
        f"SELECT key, month(ts) AS month, monthname(ts) AS month_name, {r('avg(sell)', 4, 'mean')}, {r('stddev_samp(sell)', 4, 'std')} FROM quotes GROUP BY ALL",
        "quotes",
    ),
)
def a4(spark, d):
    return rounded(explore.seasonal(fx.quotes(spark, d), ["key"], "ts", "sell", "month"), 4)


@query(
    "a5_weekday",
    f"""SELECT l_returnflag AS key, isodow(l_shipdate) - 1 AS weekday, dayname(l_shipdate) AS weekday_name, {r('avg(l_extendedprice)', 3, 'mean')},
    {r('stddev_samp(l_extendedprice)', 3, 'std')} FROM lineitem GROUP BY ALL""",
)
def a5(spark, d):
    rows = read_table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "key")
    return rounded(explore.seasonal(rows, ["key"], "l_shipdate", "l_extendedprice", "weekday"), 3)


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql(pairs) -> str:
    return "\nUNION ALL ".join(
        f"SELECT l_returnflag AS key, '{a}' AS \"left\", '{b}' AS \"right\", {r(f'corr({a}, {b})', 8, 'corr')} FROM lineitem GROUP BY ALL" for a, b in pairs
    )


def _items(spark, d):
    return read_table(spark, d, "lineitem").select(F.col("l_returnflag").alias("key"), *NUMBERS)


@query("a6_corr_matrix", _corr_sql([(a, b) for a in NUMBERS for b in NUMBERS]))
def a6(spark, d):
    return rounded(explore.corr_matrix(_items(spark, d), ["key"], NUMBERS), 8)


@query("a7_corr_triangle", _corr_sql([(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[:i]]))
def a7(spark, d):
    return rounded(explore.corr_matrix(_items(spark, d), ["key"], NUMBERS, triangle=True), 8)


@query(
    "a8_rank_corr",
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {r(f'corr({c}, l_extendedprice)', 8, 'corr')}, {r(f'abs(corr({c}, l_extendedprice))', 8, 'strength')} FROM lineitem"
        for c in NUMBERS
        if c != "l_extendedprice"
    ),
)
def a8(spark, d):
    return rounded(explore.rank_corr(_items(spark, d), "l_extendedprice", NUMBERS), 8)


OUTLIERS = f"""SELECT *, coalesce(sell < q1 - (q3 - q1) * 1.5 OR sell > q3 + (q3 - q1) * 1.5, false) AS iqr,
  coalesce(abs((sell - m) / nullif(sd, 0)) > 3, false) AS z FROM quotes JOIN
  (SELECT key, quantile_cont(sell, 0.25) AS q1, quantile_cont(sell, 0.75) AS q3, avg(sell) AS m, stddev_pop(sell) AS sd FROM quotes GROUP BY key) USING (key)"""


@query(
    "a9_outlier_summary",
    fx.sql(
        f"""SELECT key, count(*) FILTER (WHERE z) AS z_count, {r('count(*) FILTER (WHERE z) / count(*)::DOUBLE * 100', 6, 'z_pct')},
        count(*) FILTER (WHERE iqr) AS iqr_count, {r('count(*) FILTER (WHERE iqr) / count(*)::DOUBLE * 100', 6, 'iqr_pct')} FROM o GROUP BY key""",
        "quotes",
        o=OUTLIERS,
    ),
)
def a9(spark, d):
    return rounded(explore.outlier_summary(fx.quotes(spark, d), ["key"], "sell"), 6)


@query("a9_outlier_rows", fx.sql(f"SELECT {STAMP}, sell FROM o WHERE iqr", "quotes", o=OUTLIERS))
def a9_rows(spark, d):
    return fx.dated(explore.outlier_rows(fx.quotes(spark, d).select("key", "ts", "sell"), ["key"], "sell"))


CHANGES = f"SELECT *, (sell / nullif(lag(sell) OVER ({SERIES}), 0) - 1) * 100 AS change FROM quotes"


@query(
    "a10_a13_return_stats",
    fx.sql(
        f"""SELECT key, {r('avg(change)', 5, 'mean')}, {r('stddev_samp(change)', 5, 'std')}, {r('max(change)', 5, 'max_gain')}, {r('min(change)', 5, 'max_loss')},
        CASE WHEN avg(change) > 0 THEN 'Upward' ELSE 'Downward' END AS trend FROM c GROUP BY key""",
        "quotes",
        c=CHANGES,
    ),
)
def a10(spark, d):
    return rounded(explore.return_stats(fx.quotes(spark, d), fx.QUOTE, "sell"), 5)


@query(
    "a11_most_volatile",
    fx.sql(
        f"""SELECT {STAMP}, {r('v', 4, 'volatility')} FROM (SELECT key, ts, count(*) OVER (PARTITION BY key) AS n,
        CASE WHEN count(change) OVER w = 30 THEN stddev_samp(change) OVER w END AS v FROM c WINDOW w AS ({SERIES} ROWS 29 PRECEDING))
        WHERE n > 30 AND v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY v DESC, ts) = 1""",
        "quotes",
        c=CHANGES,
    ),
)
def a11(spark, d):
    return rounded(fx.dated(explore.most_volatile(fx.quotes(spark, d), fx.QUOTE, "sell")), 4)


@query(
    "a12_momentum_label",
    fx.sql(
        f"""SELECT key, {r('avg(change)', 6, 'recent_change')}, CASE WHEN avg(change) > 0.1 THEN 'Bullish' WHEN avg(change) < -0.1 THEN 'Bearish' ELSE 'Neutral' END AS momentum
        FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC) <= 7) GROUP BY key""",
        "order_quotes",
        c=CHANGES.replace("FROM quotes", "FROM order_quotes"),
    ),
)
def a12(spark, d):
    return rounded(explore.momentum_label(fx.order_quotes(spark, d), fx.QUOTE, "sell"), 6)


@query(
    "a14_histogram",
    fx.sql(
        f"""SELECT key, bin, {r('lo + w * bin', 4, '"from"')}, {r('lo + w * (bin + 1)', 4, '"to"')}, coalesce(c, 0) AS count,
        {r('coalesce(c, 0) / (n * w)', 9, 'density')} FROM slots LEFT JOIN counted USING (key, bin)""",
        ends="SELECT l_returnflag AS key, min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 30 AS w, count(*) AS n FROM lineitem GROUP BY ALL",
        slots="SELECT ends.*, range AS bin FROM ends, range(0, 30)",
        counted="""SELECT key, CAST(least(floor((l_extendedprice - lo) / w), 29) AS BIGINT) AS bin, count(*) AS c
        FROM lineitem JOIN ends ON l_returnflag = key GROUP BY ALL""",
    ),
)
def a14(spark, d):
    return rounded(rounded(explore.histogram(_items(spark, d), ["key"], "l_extendedprice", 30), 4, "from", "to"), 9, "density")


@query(
    "a15_box_stats",
    fx.sql(
        f"""SELECT key, {r('any_value(q25)', 6, 'q25')}, {r('any_value(q50)', 6, 'q50')}, {r('any_value(q75)', 6, 'q75')},
        min(x) FILTER (WHERE x BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS whisker_low,
        max(x) FILTER (WHERE x BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS whisker_high,
        count(*) FILTER (WHERE x NOT BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS fliers
        FROM (SELECT event_type AS key, value AS x FROM events) JOIN q USING (key) GROUP BY key""",
        q="SELECT event_type AS key, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75 FROM events GROUP BY ALL",
    ),
)
def a15(spark, d):
    rows = fx.requests(spark, d).withColumnRenamed("job", "key")
    return rounded(explore.box_stats(rows, ["key"], "latency_ms"), 6, "q25", "q50", "q75")


@query("a16_qq_points")
def a16(spark, d):
    residuals = fx.predictions(spark, d).withColumn("error", F.col("y_true") - F.col("y_pred"))
    return rounded(explore.qq_points(residuals, fx.QUOTE, "error"), 4)


@query("a17_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def a17(spark, d):
    rows = read_table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return explore.top_n(rows, "o_totalprice", 15, ["o_orderkey"])


@query(
    "a18_forecast_summary",
    fx.sql(
        f"""SELECT key, min(y_pred) AS lowest, max(y_pred) AS highest, {r('avg(y_pred)', 4, 'average')}, {r('avg(step)', 5, 'average_step')}
        FROM (SELECT *, y_pred - lag(y_pred) OVER ({SERIES}) AS step FROM predictions) GROUP BY key""",
        "predictions",
    ),
)
def a18(spark, d):
    out = explore.forecast_summary(fx.predictions(spark, d), fx.QUOTE, "y_pred")
    return rounded(rounded(out, 4, "average"), 5, "average_step")
