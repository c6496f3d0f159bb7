"""Queries: scaling, sequences, splits, folds, the whole preparation."""
from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.columns import rounded
from tickloom.operators import lags, scaling, sequences
from tickloom.operators.blocks import add_features
from tickloom.plans import features as feat
from tickloom.plans import fixtures as fx
from tickloom.plans.features import SERIES, STAMP
from tickloom.plans.preparation import Preparation, preprocess, transform_new
from tickloom.plans.registry import query, r
from tickloom.sources.session import new_path, settle

BOTH = ["sell", "buy"]


def _scaled_sql(text: str, source: str = "quotes") -> str:
    """``text`` scales column {0} from key-wide values."""
    return fx.sql(f"SELECT {STAMP}, {', '.join(r(text.format(c), 6, c) for c in BOTH)} FROM {source} WINDOW k AS (PARTITION BY key)", source)


MINMAX = "({0} - min({0}) OVER k) / (max({0}) OVER k - min({0}) OVER k) * {{hi}} + {{lo}}"
STANDARD = "({0} - avg({0}) OVER k) / stddev_pop({0}) OVER k"
ROBUST = "({0} - quantile_cont({0}, 0.5) OVER k) / (quantile_cont({0}, 0.75) OVER k - quantile_cont({0}, 0.25) OVER k)"


def _minmax(lo: float, hi: float) -> str:
    return MINMAX.replace("{{hi}}", str(hi - lo)).replace("{{lo}}", str(lo))


def _scaled(spark, d, kind, base=fx.quotes, **how):
    rows = base(spark, d).select("key", "ts", *BOTH)
    return rounded(fx.dated(scaling.fit_scaler(rows, BOTH, kind, ["key"], **how).transform(rows)), 6)


@query("n2_minmax", _scaled_sql(_minmax(-1, 1)))
def n2(spark, d):
    return _scaled(spark, d, "minmax", low=-1.0, high=1.0)


@query("n3_standard", _scaled_sql(STANDARD))
def n3(spark, d):
    return _scaled(spark, d, "standard")


@query("n4_robust", _scaled_sql(ROBUST))
def n4(spark, d):
    return _scaled(spark, d, "robust")


@query(
    "n6_fit_then_transform",
    fx.sql(
        f"""SELECT {STAMP}, {r('(sell - lo) / (hi - lo)', 6, 'sell')} FROM order_quotes JOIN
        (SELECT key, min(sell) AS lo, max(sell) AS hi FROM order_quotes WHERE ts < DATE '1999-01-01' GROUP BY key) USING (key)""",
        "order_quotes",
    ),
)
def n6(spark, d):
    rows = fx.order_quotes(spark, d)
    fitted = scaling.fit_scaler(rows.where("ts < date '1999-01-01'"), ["sell"], "minmax", ["key"])
    return rounded(fx.dated(fitted.transform(rows)), 6)


@query("n7_inverse", fx.sql(f"SELECT {STAMP}, {r('sell', 6, 'forecast')} FROM order_quotes", "order_quotes"))
def n7(spark, d):
    rows = fx.order_quotes(spark, d)
    fitted = scaling.fit_scaler(rows, ["sell"], "standard", ["key"])
    scaled = fitted.transform(rows).withColumnRenamed("sell", "forecast")
    return rounded(fx.dated(fitted.inverse(scaled, "forecast", "sell")), 6)


@query("s7_save_and_load_scaler", _scaled_sql(_minmax(0, 1)))
def s7(spark, d):
    rows = fx.quotes(spark, d).select("key", "ts", *BOTH)
    path = new_path(spark, "fitted")
    scaling.fit_scaler(rows, BOTH, "minmax", ["key"]).save(path)
    return rounded(fx.dated(scaling.Scaler.load(spark, path).transform(rows)), 6)


def _sequence_sql(source: str, length: int, horizon: int) -> str:
    back, ahead = length - 1, horizon
    return fx.sql(
        f"""SELECT key, CAST(ts AS VARCHAR) AS ts, size, first_sell, last_sell, {r('sum_buy', 4, 'sum_buy')}, first_target, last_target FROM (
        SELECT key, ts, count(*) OVER past AS size, first_value(sell) OVER past AS first_sell, last_value(sell) OVER past AS last_sell,
        sum(buy) OVER past AS sum_buy, lead(sell, 1) OVER w AS first_target, lead(sell, {ahead}) OVER w AS last_target FROM {source}
        WINDOW w AS ({SERIES}), past AS ({SERIES} ROWS {back} PRECEDING)) WHERE size = {length} AND last_target IS NOT NULL""",
        source,
    )


def _sequence_shape(df, horizon):
    y = F.array(F.col("target")) if horizon == 1 else F.col("target")
    f = F.col("features")
    return fx.dated(
        df.select(
            "key",
            "ts",
            F.size(f).alias("size"),
            f[0]["sell"].alias("first_sell"),
            F.element_at(f, -1)["sell"].alias("last_sell"),
            F.round(F.aggregate(f, F.lit(0.0), lambda a, x: a + x["buy"]), 4).alias("sum_buy"),
            F.element_at(y, 1).alias("first_target"),
            F.element_at(y, -1).alias("last_target"),
        )
    )


@query("n8_sequences_horizon", _sequence_sql("quotes", 60, 5))
def n8(spark, d):
    return _sequence_shape(sequences.make_sequences(fx.quotes(spark, d), fx.QUOTE, BOTH, "sell", 60, 5), 5)


@query("n9_sequences_single_target", _sequence_sql("quotes", 30, 1))
def n9(spark, d):
    return _sequence_shape(sequences.make_sequences(fx.quotes(spark, d), fx.QUOTE, BOTH, "sell", 30, 1), 1)


RANKED = "SELECT key, ts, sell, row_number() OVER (PARTITION BY key ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM {0}"


@query(
    "n10_split_by_time",
    fx.sql(
        f"""SELECT {STAMP}, CASE WHEN pos < floor(n * 0.8::DOUBLE) THEN 'train' WHEN pos < floor(n * 0.9::DOUBLE) THEN 'validation' ELSE 'test' END AS split
        FROM ranked""",
        "supplier_quotes",
        ranked=RANKED.format("supplier_quotes"),
    ),
)
def n10(spark, d):
    return fx.dated(sequences.split_by_time(fx.supplier_quotes(spark, d), fx.QUOTE).select("key", "ts", "split"))


@query(
    "n11_ts_folds",
    fx.sql(
        """SELECT key, fold, part, count(*) AS n, CAST(min(ts) AS VARCHAR) AS first, CAST(max(ts) AS VARCHAR) AS last FROM (
        SELECT *, CASE WHEN pos < n - (6 - fold) * (n // 6) THEN 'train' WHEN pos < n - (5 - fold) * (n // 6) THEN 'test' END AS part
        FROM ranked, (SELECT range AS fold FROM range(1, 6))) WHERE part IS NOT NULL GROUP BY ALL""",
        "supplier_quotes",
        ranked=RANKED.format("supplier_quotes"),
    ),
)
def n11(spark, d):
    return _fold_shape(sequences.ts_folds(fx.supplier_quotes(spark, d), fx.QUOTE, 5))


def _fold_shape(folds):
    return fx.dated(
        folds.groupBy("key", "fold", "part").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    )


@query(
    "n12_kfold",
    fx.sql(f"SELECT {STAMP}, (('0x' || md5('42|' || key || '|' || CAST(ts AS VARCHAR))[1:8])::BIGINT % 5) + 1 AS fold FROM supplier_quotes", "supplier_quotes"),
)
def n12(spark, d):
    return fx.dated(sequences.kfold(fx.supplier_quotes(spark, d).select("key", "ts"), ["key", "ts"]))


WALK_SQL = """SELECT r.*, f AS fold, CASE WHEN pos >= 250 + (f - 1) * 100 - 250 AND pos < 250 + (f - 1) * 100 THEN 'train'
  WHEN pos >= 250 + (f - 1) * 100 AND pos < 250 + (f - 1) * 100 + 20 THEN 'test' END AS part
  FROM ranked r, (SELECT range AS f FROM range(1, 100)) WHERE 250 + (f - 1) * 100 + 20 < n"""


@query(
    "n13_walk_forward",
    fx.sql(
        """SELECT key, fold, part, count(*) AS n, CAST(min(ts) AS VARCHAR) AS first, CAST(max(ts) AS VARCHAR) AS last
        FROM walk WHERE part IS NOT NULL GROUP BY ALL""",
        "quotes",
        ranked=RANKED.format("quotes"),
        walk=WALK_SQL,
    ),
)
def n13(spark, d):
    return _fold_shape(sequences.walk_forward(fx.quotes(spark, d), fx.QUOTE, 250, 100, 20))


PREPARE = Preparation(fx.QUOTE)


@query(
    "n1_scalable_columns",
    fx.sql("SELECT c AS \"column\", (SELECT count(*) FROM quotes) AS n FROM (VALUES ('sell'), ('buy'), ('time_month_sin'), ('time_month_cos')) v(c)", "quotes"),
)
def n1(spark, d):
    from tickloom.functions.calendar import calendar_columns

    wanted = ("time_year", "time_month", "time_month_sin", "time_month_cos", "time_is_weekend")
    wide = fx.quotes(spark, d).withColumns({k: v for k, v in calendar_columns("ts").items() if k in wanted})
    names = scaling.scalable_columns(wide, "ts", ["key"])
    return wide.agg(*[F.count(c).alias(c) for c in names]).select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in names]))
    )


def _prepare_ctes(source: str) -> dict[str, str]:
    return {
        "base": f"SELECT key, ts, sell, buy, row_number() OVER ({SERIES}) AS rn FROM {source}",
        "kept": f"""SELECT key, ts, sell, buy, lag30, row_number() OVER ({SERIES}) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n
          FROM (SELECT *, lag(sell, 30) OVER ({SERIES}) AS lag30 FROM base) WHERE rn >= 50""",
        "labelled": """SELECT *, CASE WHEN pos < floor(n * 0.8::DOUBLE) THEN 'train' WHEN pos < floor(n * 0.9::DOUBLE) THEN 'validation'
          ELSE 'test' END AS split FROM kept""",
        "fitted": "SELECT key, min(sell) AS lo, max(sell) AS hi, min(lag30) AS lo30, max(lag30) AS hi30 FROM labelled WHERE split = 'train' GROUP BY key",
        "scaled": "SELECT key, ts, split, pos, (sell - lo) / (hi - lo) AS sell, (lag30 - lo30) / (hi30 - lo30) AS sell_lag_30 FROM labelled JOIN fitted USING (key)",
    }


@query(
    "n14_preprocess_features",
    fx.sql(f"SELECT {STAMP}, split, {r('sell', 6, 'sell')}, {r('sell_lag_30', 6, 'sell_lag_30')} FROM scaled", "quotes", **_prepare_ctes("quotes")),
)
def n14(spark, d):
    # quotes are complete, unique and kept as they are: no outlier replacement enters the twin
    from tickloom.plans.preparation import featured

    wide = settle(featured(fx.quotes(spark, d), PREPARE), "features")
    split = sequences.split_by_time(wide, fx.QUOTE, *PREPARE.shares)
    columns = ["sell", "sell_lag_30"]
    fitted = scaling.fit_scaler(split.where("split = 'train'"), columns, "minmax", ["key"])
    return rounded(fx.dated(fitted.transform(split).select("key", "ts", "split", *columns)), 6)


def _text_quotes(spark, d):
    return fx.quotes(spark, d).select("key", *[F.col(c).cast("string").alias(c) for c in ("ts", "sell", "buy")])


@query(
    "n14_preprocess_sequences",
    fx.sql(
        "SELECT key, n - 49 - 60 AS windows, 60 AS length FROM (SELECT key, count(*) AS n FROM quotes GROUP BY key)",
        "quotes",
    ),
)
def n14_sequences(spark, d):
    ready = preprocess(_text_quotes(spark, d), PREPARE)
    return ready.sequences.groupBy("key").agg(
        F.count("*").alias("windows"), F.max(F.size("features")).alias("length")
    )


@query(
    "c18_transform_new",
    fx.sql(f"SELECT {STAMP}, {r('(sell - lo) / (hi - lo)', 6, 'sell')} FROM kept JOIN fitted_all USING (key)", "order_quotes",
        base=f"SELECT key, ts, sell, row_number() OVER ({SERIES}) AS rn FROM order_quotes",
        kept="SELECT * FROM base WHERE rn >= 50",
        fitted_all="SELECT key, min(sell) AS lo, max(sell) AS hi FROM base GROUP BY key",
    ),
)
def c18(spark, d):
    rows = fx.order_quotes(spark, d).withColumn("buy", F.col("sell") - 1)
    fitted = scaling.fit_scaler(rows, ["sell"], "minmax", ["key"])
    text = rows.select("key", *[F.col(c).cast("string").alias(c) for c in ("ts", "sell", "buy")])
    new = transform_new(text, PREPARE, fitted).withColumn("ts", F.to_date("ts"))
    return rounded(fx.dated(new.select("key", "ts", "sell")), 6)
