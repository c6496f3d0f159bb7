"""Queries: calendar fields, lags and returns, rolling windows and indicators."""
from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import calendar
from tickloom.functions.columns import pct_change_or_zero, rounded
from tickloom.operators import indicators as ind
from tickloom.operators import lags
from tickloom.operators.blocks import add_features
from tickloom.plans import fixtures as fx
from tickloom.plans.registry import query, r

SERIES = "PARTITION BY key ORDER BY ts"
STAMP = "key, CAST(ts AS VARCHAR) AS ts"


def _calendar(spark, d, names, base=fx.supplier_quotes):
    fields = calendar.calendar_columns("ts", prefix="")
    return fx.dated(base(spark, d).select("key", "ts", *[fields[n].alias(n) for n in names]))


def _calendar_query(name, columns, base="supplier_quotes", digits=None):
    """Register one calendar query: column -> SQL text."""
    shown = ", ".join(r(text, digits, c) if digits else f"{text} AS {c}" for c, text in columns.items())

    @query(name, fx.sql(f"SELECT {STAMP}, {shown} FROM {base}", base))
    def build(spark, d):
        out = _calendar(spark, d, list(columns), getattr(fx, base))
        return rounded(out, digits) if digits else out


_calendar_query("d1_year_month_day", {"year": "year(ts)", "month": "month(ts)", "day": "day(ts)"})
_calendar_query("d2_weekday", {"weekday": "isodow(ts) - 1"})
_calendar_query("d3_quarter_day_of_year", {"quarter": "quarter(ts)", "day_of_year": "dayofyear(ts)"})
_calendar_query("d4_iso_week", {"week_of_year": "week(ts)"})
for _id, _name, _value, _period in (
    ("d5", "month", "month(ts)", 12),
    ("d6", "day", "day(ts)", 31),
    ("d7", "weekday", "(isodow(ts) - 1)", 7),
):
    _calendar_query(
        f"{_id}_{_name}_cycle",
        {f"{_name}_{f}": f"{f}(2 * pi() * {_value} / {_period})" for f in ("sin", "cos")},
        "quotes",
        6,
    )
_calendar_query("d8_business_day", {"is_business_day": "isodow(ts) <= 5", "is_weekend": "isodow(ts) > 5"})
_calendar_query("d9_month_edges", {"is_month_start": "day(ts) = 1", "is_month_end": "ts = last_day(ts)"})
_calendar_query(
    "d10_quarter_edges",
    {"is_quarter_start": "day(ts) = 1 AND month(ts) % 3 = 1", "is_quarter_end": "ts = last_day(ts) AND month(ts) % 3 = 0"},
)


@query("d11_names", fx.sql(f"SELECT {STAMP}, monthname(ts) AS month_name, dayname(ts) AS weekday_name FROM supplier_quotes", "supplier_quotes"))
def d11(spark, d):
    return fx.dated(calendar.add_names(fx.supplier_quotes(spark, d).select("key", "ts")))


@query(
    "d12_future_dates",
    fx.sql(
        """SELECT key, step, CAST(CAST(last + step AS DATE) AS VARCHAR) AS ts FROM
        (SELECT key, max(ts) AS last FROM supplier_quotes GROUP BY key), (SELECT CAST(range AS INTEGER) AS step FROM range(1, 15))""",
        "supplier_quotes",
    ),
)
def d12(spark, d):
    return fx.dated(calendar.future_dates(fx.supplier_quotes(spark, d), fx.QUOTE, 14))


@query(
    "d13_span",
    fx.sql(
        """SELECT key, CAST(min(ts) AS VARCHAR) AS first, CAST(max(ts) AS VARCHAR) AS last,
        date_diff('day', min(ts), max(ts)) AS days FROM supplier_quotes GROUP BY key""",
        "supplier_quotes",
    ),
)
def d13(spark, d):
    return fx.dated(calendar.span(fx.supplier_quotes(spark, d), fx.QUOTE))


# lags and returns


def _featured(spark, d, *features, base=fx.quotes):
    return fx.dated(add_features(base(spark, d), fx.QUOTE, *features))


def _shown(names) -> str:
    return ", ".join(names)


LAG_SQL = ", ".join(f"lag({c}, {k}) OVER w AS {c}_lag_{k}" for c in ("sell", "buy") for k in (1, 2, 3, 5, 7, 14, 30))


@query("l1_lags", fx.sql(f"SELECT {STAMP}, sell, buy, {LAG_SQL} FROM quotes WINDOW w AS ({SERIES})", "quotes"))
def l1(spark, d):
    return _featured(spark, d, lags.lags(["sell", "buy"]))


@query("l2_difference", fx.sql(f"SELECT {STAMP}, sell, sell - lag(sell) OVER ({SERIES}) AS sell_diff FROM supplier_quotes", "supplier_quotes"))
def l2(spark, d):
    return _featured(spark, d, lags.difference("sell"), base=fx.supplier_quotes).drop("buy")


def _change_sql(names: dict[str, int], scale: int = 1) -> str:
    return ", ".join(
        r(f"(sell / nullif(lag(sell, {k}) OVER ({SERIES}), 0) - 1) * {scale}", 6, name) for name, k in names.items()
    )


@query("l3_momentum", fx.sql(f"SELECT {STAMP}, {_change_sql({f'momentum_{k}': k for k in (1, 3, 7)})} FROM quotes", "quotes"))
def l3(spark, d):
    return rounded(_featured(spark, d, lags.momentum("sell")).drop("sell", "buy"), 6)


@query("l4_returns", fx.sql(f"SELECT {STAMP}, {_change_sql({f'return_{k}d': k for k in (1, 3, 7)})} FROM order_quotes", "order_quotes"))
def l4(spark, d):
    return rounded(_featured(spark, d, lags.returns("sell"), base=fx.order_quotes).drop("sell"), 6)


@query(
    "l5_spread",
    fx.sql(
        f"""SELECT {STAMP}, sell, buy, sell - buy AS price_diff, {r('sell / nullif(buy, 0)', 9, 'price_ratio')},
        {r('(sell - buy) / nullif(buy, 0) * 100', 9, 'price_spread_pct')} FROM supplier_quotes""",
        "supplier_quotes",
    ),
)
def l5(spark, d):
    return rounded(fx.dated(lags.add_spread(fx.supplier_quotes(spark, d))), 9, "price_ratio", "price_spread_pct")


@query("l6_price_change", fx.sql(f"SELECT {STAMP}, {_change_sql({'price_change': 1}, 100)} FROM quotes", "quotes"))
def l6(spark, d):
    return rounded(_featured(spark, d, lags.price_change("sell")).drop("sell", "buy"), 6)


@query(
    "l7_pct_change_or_zero",
    fx.sql(
        f"SELECT {STAMP}, {r('CASE WHEN y_pred = 0 THEN 0 ELSE (y_true - y_pred) / y_pred * 100 END', 6, 'change_pct')} FROM predictions",
        "predictions",
    ),
)
def l7(spark, d):
    return rounded(fx.dated(fx.predictions(spark, d).select("key", "ts", pct_change_or_zero("y_pred", "y_true").alias("change_pct"))), 6)


# rolling windows


class Windows:
    """SQL text over the last n rows, null until n values are there."""

    def __init__(self):
        self.sizes = set()

    def of(self, fold: str, n: int, column: str = "sell") -> str:
        self.sizes.add(n)
        return f"CASE WHEN count({column}) OVER w{n} = {n} THEN {fold}({column}) OVER w{n} END"

    def clause(self) -> str:
        return "WINDOW w AS (" + SERIES + "), " + ", ".join(f"w{n} AS ({SERIES} ROWS {n - 1} PRECEDING)" for n in sorted(self.sizes))


def _rolling_sql(columns, base: str = "quotes", digits: int = 4, **more) -> str:
    """``columns``: function of a Windows object giving name -> text."""
    w = Windows()
    shown = ", ".join(r(text, digits, name) for name, text in columns(w).items())
    return fx.sql(f"SELECT {STAMP}, {shown} FROM {base} {w.clause()}", *(() if base in more else (base,)), **more)


def _only(df, digits=4):
    return rounded(df.drop("sell", "buy"), digits)


def sma_sql(w):
    return {f"sma_{n}": w.of("avg", n) for n in (5, 10, 20, 50)}


@query("w1_sma", _rolling_sql(sma_sql))
def w1(spark, d):
    return _only(_featured(spark, d, ind.sma("sell")))


def _ewm_sql(names: dict[str, int], source: str, column: str, reach: int) -> str:
    """Exponential means by joining each row with the ``reach`` rows before it."""
    parts = []
    for name, span in names.items():
        weight = f"pow({span - 1}.0 / {span + 1}.0, a.rn - b.rn)"
        parts.append(f"sum(b.{column} * {weight}) / sum({weight}) AS {name}")
    return f"""SELECT a.key, a.ts, a.rn, {', '.join(parts)} FROM {source} a
      JOIN {source} b ON a.key = b.key AND b.rn BETWEEN a.rn - {reach} AND a.rn GROUP BY a.key, a.ts, a.rn"""


NUMBERED = f"SELECT key, ts, sell, row_number() OVER ({SERIES}) AS rn FROM quotes"
EMA_SQL = _ewm_sql({f"ema_{n}": n for n in (5, 10, 20, 50)}, "numbered", "sell", 1100)
MACD_CTES = {
    "lines": _ewm_sql({"fast": 12, "slow": 26}, "numbered", "sell", 600),
    "diffs": "SELECT key, ts, rn, fast - slow AS macd FROM lines",
    "signals": _ewm_sql({"macd_signal": 9}, "diffs", "macd", 250),
    "macds": "SELECT d.key, d.ts, macd, macd_signal, macd - macd_signal AS macd_histogram FROM diffs d JOIN signals g ON d.key = g.key AND d.rn = g.rn",
}
MACD_NAMES = ("macd", "macd_signal", "macd_histogram")


@query(
    "w2_ema",
    fx.sql(f"SELECT {STAMP}, {', '.join(r(f'ema_{n}', 4, f'ema_{n}') for n in (5, 10, 20, 50))} FROM emas", "quotes", numbered=NUMBERED, emas=EMA_SQL),
)
def w2(spark, d):
    return _only(_featured(spark, d, ind.ema("sell")))


def _uncut_ewm_sql(spans: tuple[int, ...]) -> str:
    """Exponential means over all earlier rows; weights count from the last value, so that they hold over gaps."""
    weights = {n: f"pow({n - 1}.0 / {n + 1}.0, a.held - b.rn)" for n in spans}
    means = ", ".join(r(f"sum(b.sell * {w}) / sum({w})", 4, f"ema_{n}") for n, w in weights.items())
    return f"""SELECT a.key, CAST(a.ts AS VARCHAR) AS ts, {means} FROM held a
      LEFT JOIN held b ON a.key = b.key AND b.rn <= a.rn AND b.sell IS NOT NULL GROUP BY a.key, a.ts"""


WIDE_SPANS = (1, 5, 100, 200)
HELD = f"""SELECT *, max(CASE WHEN sell IS NOT NULL THEN rn END) OVER ({SERIES}) AS held
  FROM (SELECT *, row_number() OVER ({SERIES}) AS rn FROM sparse_quotes)"""


@query("w2_ema_any_spans", fx.sql(_uncut_ewm_sql(WIDE_SPANS), "sparse_quotes", held=HELD))
def w2_any_spans(spark, d):
    return _only(add_features(fx.sparse_quotes(spark, d), fx.QUOTE.with_rows(500), ind.ema("sell", WIDE_SPANS)))


PERIOD_CTES = {
    "lines": _uncut_ewm_sql((12, 26)).replace("round(", "(").replace(", 4) + 0.0", ")").replace("CAST(a.ts AS VARCHAR) AS ts", "a.ts AS ts, any_value(a.rn) AS rn"),
    "diffs": "SELECT key, ts, rn, ema_12 - ema_26 AS macd FROM lines",
    "signals": """SELECT a.key, a.ts, sum(b.macd * pow(0.8, a.rn - b.rn)) / sum(pow(0.8, a.rn - b.rn)) AS macd_signal FROM diffs a
      JOIN diffs b ON a.key = b.key AND b.rn <= a.rn AND b.rn > a.rn - 2000 AND b.macd IS NOT NULL GROUP BY a.key, a.ts""",
}


@query(
    "w4_macd_over_gaps",
    fx.sql(
        f"SELECT d.key, CAST(d.ts AS VARCHAR) AS ts, {r('macd', 4, 'macd')}, {r('macd_signal', 4, 'macd_signal')}, {r('macd - macd_signal', 4, 'macd_histogram')} "
        "FROM diffs d LEFT JOIN signals s ON d.key = s.key AND d.ts = s.ts",
        "sparse_quotes",
        held=HELD,
        **PERIOD_CTES,
    ),
)
def w4_over_gaps(spark, d):
    return _only(add_features(fx.sparse_quotes(spark, d), fx.QUOTE.with_rows(500), ind.macd("sell")))


RSI_CTES = {
    "moves": f"SELECT *, sell - lag(sell) OVER ({SERIES}) AS step FROM quotes",
    "sides": "SELECT *, CASE WHEN step > 0 THEN step ELSE 0 END AS gain, CASE WHEN step < 0 THEN -step ELSE 0 END AS loss FROM moves",
    "rsis": f"""SELECT key, ts, CASE WHEN count(*) OVER w14 = 14 THEN
      100 * sum(gain) OVER w14 / nullif(sum(gain) OVER w14 + sum(loss) OVER w14, 0) END AS rsi FROM sides
      WINDOW w14 AS ({SERIES} ROWS 13 PRECEDING)""",
}


@query("w3_rsi", fx.sql(f"SELECT {STAMP}, {r('rsi', 4, 'rsi')} FROM rsis", "quotes", **RSI_CTES))
def w3(spark, d):
    return _only(_featured(spark, d, ind.rsi("sell")))


@query(
    "w4_w5_macd",
    fx.sql(f"SELECT {STAMP}, {', '.join(r(n, 4, n) for n in MACD_NAMES)} FROM macds", "quotes", numbered=NUMBERED, **MACD_CTES),
)
def w4(spark, d):
    return _only(_featured(spark, d, ind.macd("sell")))


def band_sql(w):
    mid, std = w.of("avg", 20), w.of("stddev_samp", 20)
    return {
        "bollinger_upper": f"{mid} + 2 * {std}",
        "bollinger_lower": f"{mid} - 2 * {std}",
        "bollinger_width": f"4 * {std}",
    }


@query("w6_bollinger", _rolling_sql(band_sql))
def w6(spark, d):
    return _only(_featured(spark, d, ind.bollinger("sell")))


def volatility_sql(w):
    return {f"volatility_{n}": w.of("stddev_samp", n) for n in (5, 10, 20)}


@query("w7_volatility", _rolling_sql(volatility_sql, "order_quotes"))
def w7(spark, d):
    return _only(_featured(spark, d, ind.volatility("sell"), base=fx.order_quotes))


def stats_sql(w):
    folds = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    return {f"rolling_{k}_{n}": w.of(f, n) for n in (5, 10, 20) for k, f in folds.items()}


@query("w8_rolling_stats", _rolling_sql(stats_sql, digits=3))
def w8(spark, d):
    return _only(_featured(spark, d, ind.rolling_stats("sell")), 3)


def position_sql(w):
    out = {}
    for n in (10, 20, 50):
        low, high = w.of("min", n), w.of("max", n)
        out[f"price_position_{n}"] = f"(sell - {low}) / nullif({high} - {low}, 0)"
    return out


@query("w9_price_position", _rolling_sql(position_sql, "supplier_quotes", digits=9))
def w9(spark, d):
    return _only(_featured(spark, d, ind.price_position("sell"), base=fx.supplier_quotes), 9)


@query(
    "w10_return_volatility",
    _rolling_sql(
        lambda w: {"volatility": w.of("stddev_samp", 30, "change")},
        "changes",
        quotes=fx.FIXTURE_SQL["quotes"][1],
        changes=f"SELECT key, ts, (sell / lag(sell) OVER ({SERIES}) - 1) * 100 AS change FROM quotes",
    ),
)
def w10(spark, d):
    return _only(_featured(spark, d, ind.return_volatility("sell")))


def momentum_sql(w):
    return {f"momentum_{k}": f"sell / nullif(lag(sell, {k}) OVER w, 0) - 1" for k in (1, 3, 7)}


def _indicator_sql() -> str:
    w = Windows()
    rolled = {**sma_sql(w), **band_sql(w), **volatility_sql(w), **momentum_sql(w)}
    texts = ", ".join(f"{text} AS {name}" for name, text in rolled.items())
    names = [*rolled, *(f"ema_{n}" for n in (5, 10, 20, 50)), *MACD_NAMES, "rsi"]
    return fx.sql(
        f"""SELECT rolled.key, CAST(rolled.ts AS VARCHAR) AS ts, {', '.join(r(n, 4, n) for n in names)} FROM rolled
        JOIN emas ON rolled.key = emas.key AND rolled.ts = emas.ts JOIN macds ON rolled.key = macds.key AND rolled.ts = macds.ts
        JOIN rsis ON rolled.key = rsis.key AND rolled.ts = rsis.ts""",
        "quotes",
        numbered=NUMBERED,
        emas=EMA_SQL,
        rolled=f"SELECT key, ts, {texts} FROM quotes {w.clause()}",
        **MACD_CTES,
        **RSI_CTES,
    )


@query("w11_indicators", _indicator_sql())
def w11(spark, d):
    return _only(_featured(spark, d, *ind.indicators("sell")))


@query(
    "w12_derived",
    _rolling_sql(
        lambda w: {
            "price_diff": "sell - buy",
            "price_ratio": "sell / nullif(buy, 0)",
            "price_spread_pct": "(sell - buy) / nullif(buy, 0) * 100",
            **{f"return_{k}d": f"sell / nullif(lag(sell, {k}) OVER w, 0) - 1" for k in (1, 3, 7)},
            **stats_sql(w),
            **position_sql(w),
        },
        digits=3,
    ),
)
def w12(spark, d):
    return _only(_featured(spark, d, *ind.derived()), 3)


@query(
    "w13_rsi_zones",
    fx.sql(
        """SELECT key, zone, count(*) AS n FROM (SELECT key, CASE WHEN rsi >= 70 THEN 'overbought' WHEN rsi <= 30 THEN 'oversold'
        WHEN rsi >= 50 THEN 'neutral_high' WHEN rsi < 50 THEN 'neutral_low' END AS zone FROM rsis) WHERE zone IS NOT NULL GROUP BY ALL""",
        "quotes",
        **RSI_CTES,
    ),
)
def w13(spark, d):
    zoned = _featured(spark, d, ind.rsi("sell")).withColumn("zone", ind.rsi_zone())
    return zoned.where("zone is not null").groupBy("key", "zone").agg(F.count("*").alias("n"))
