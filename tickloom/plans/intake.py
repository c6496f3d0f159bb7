"""Queries: sources and sinks, validation, cleaning."""
from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.columns import rounded
from tickloom.operators import cleaning, quality
from tickloom.operators.lags import add_spread
from tickloom.plans import fixtures as fx
from tickloom.plans.registry import query, r
from tickloom.sources import readers, writers
from tickloom.sources.session import new_path, settle

PRICES = ["sell", "buy"]
RAW_AS_QUOTE = {readers.ID: "id", readers.SELL: "sell", readers.BUY: "buy", readers.UPDATED: "ts"}


def _raw_files(spark, d, fmt, lines=False):
    """Write the dirty quotes in the raw file layout and read them back."""
    named = fx.dirty_quotes(spark, d).select(*[F.col(ours).alias(theirs) for theirs, ours in RAW_AS_QUOTE.items()])
    path = new_path(spark, f"raw-{fmt}")
    writer = named.write
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path))
    raw = readers.read_quotes(spark, path, fmt, lines=lines)
    return raw.select(*[F.col(theirs).alias(ours) for theirs, ours in RAW_AS_QUOTE.items()])


RAW_SQL = fx.sql("SELECT id, sell, buy, ts FROM dirty_quotes", "dirty_quotes")
TYPED_SQL = fx.sql(
    f"SELECT id, CAST(ts AS VARCHAR) AS ts, sell, buy FROM typed_quotes", "typed_quotes"
)


@query("s1_json_lines", TYPED_SQL)
def s1(spark, d):
    return fx.dated(cleaning.parse_types(_raw_files(spark, d, "json", lines=True), "ts", PRICES))


@query("s2_csv", TYPED_SQL)
def s2(spark, d):
    return fx.dated(cleaning.parse_types(_raw_files(spark, d, "csv"), "ts", PRICES))


@query(
    "s5_read_table",
    """SELECT l_returnflag AS flag, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high
    FROM lineitem GROUP BY ALL""",
)
def s5(spark, d):
    rows = readers.read_table(spark, d, "lineitem")
    return rows.groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.count("*").alias("n"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high")
    )


@query(
    "s6_write_features",
    fx.sql(f"SELECT key, CAST(ts AS VARCHAR) AS ts, strftime(ts, '%Y-%m') AS month, sell, sell - buy AS price_diff FROM quotes", "quotes"),
)
def s6(spark, d):
    path = new_path(spark, "features")
    features = writers.with_month(add_spread(fx.quotes(spark, d)).select("key", "ts", "sell", "price_diff"))
    writers.write_features(features, path, "parquet", ["month"])
    return fx.dated(spark.read.parquet(path).withColumn("month", F.col("month").cast("string")))


@query(
    "s8_prediction_summary",
    fx.sql(f"SELECT key, count(*) AS n, min(y_pred) AS lowest, max(y_pred) AS highest FROM predictions GROUP BY key", "predictions"),
)
def s8(spark, d):
    path = new_path(spark, "predictions")
    writers.write_predictions(fx.predictions(spark, d), path, "y_pred", ["key"])
    stored = spark.read.schema("key string, n bigint, lowest double, highest double").json(f"{path}/summary")
    return stored


@query(
    "s10_prediction_log",
    fx.sql(f"SELECT key, CAST(ts AS VARCHAR) AS ts, y_true, y_pred, y_true - y_pred AS error FROM predictions", "predictions"),
)
def s10(spark, d):
    path = new_path(spark, "log")
    log = writers.prediction_log(fx.predictions(spark, d))
    writers.write_features(log, path, "csv")
    schema = "key string, ts date, y_true double, y_pred double, error double"
    return fx.dated(spark.read.schema(schema).option("header", True).csv(path))


@query(
    "s11_append_metrics",
    fx.sql(
        f"""SELECT run_id, epoch, 'loss' AS metric, loss AS value FROM history
        UNION ALL SELECT run_id, epoch, 'val_loss', val_loss FROM history""",
        "history",
    ),
)
def s11(spark, d):
    path = new_path(spark, "run-log")
    for metric in ("loss", "val_loss"):
        step = fx.history(spark, d).select("run_id", "epoch", F.lit(metric).alias("metric"), F.col(metric).alias("value"))
        writers.append_metrics(step, path)
    return spark.read.parquet(path)


@query(
    "s13_align",
    fx.sql(
        f"""SELECT p.key, CAST(p.ts AS VARCHAR) AS ts, q.sell AS actual, p.y_pred AS predicted
        FROM quotes q JOIN predictions p ON q.key = p.key AND q.ts = p.ts""",
        "predictions",
    ),
)
def s13(spark, d):
    actual = fx.quotes(spark, d).select("key", "ts", F.col("sell").alias("actual"))
    predicted = fx.predictions(spark, d).select("key", "ts", F.col("y_pred").alias("predicted"))
    return fx.dated(writers.align(actual, predicted, ["key", "ts"]))


# validation

_DUP = "(count(ts) - (SELECT count(*) FROM (SELECT DISTINCT key, ts FROM typed_quotes WHERE ts IS NOT NULL)))"


@query(
    "v1_v6_validate",
    fx.sql(
        """, c AS (SELECT count(*) AS n,
          count(*) FILTER (WHERE ts IS NOT NULL AND TRY_CAST(ts AS TIMESTAMP) IS NULL) AS bad_dates,
          count(*) FILTER (WHERE sell IS NOT NULL AND TRY_CAST(sell AS DOUBLE) IS NULL) AS bad_sell,
          count(*) FILTER (WHERE buy IS NOT NULL AND TRY_CAST(buy AS DOUBLE) IS NULL) AS bad_buy FROM dirty_quotes),
        u AS (SELECT count(ts) - count(DISTINCT (key, ts)) FILTER (WHERE ts IS NOT NULL) AS dup FROM typed_quotes),
        rows AS (
          SELECT 'required_columns' AS "check", 1 AS n_bad, 'volume' AS detail, 'error' AS level
          UNION ALL SELECT 'date_format', bad_dates, 'ts', 'error' FROM c
          UNION ALL SELECT 'not_empty', CASE WHEN n = 0 THEN 1 ELSE 0 END, '', 'error' FROM c
          UNION ALL SELECT 'unique_dates', dup, 'ts', 'warning' FROM u
          UNION ALL SELECT 'numeric_sell', bad_sell, 'sell', 'error' FROM c
          UNION ALL SELECT 'numeric_buy', bad_buy, 'buy', 'error' FROM c)
        SELECT "check", n_bad = 0 AS ok, CAST(n_bad AS BIGINT) AS n_bad, detail, level FROM rows""",
        "typed_quotes",
    ).replace("\n, c AS", ", c AS"),
)
def v1(spark, d):
    return quality.validate(fx.dirty_quotes(spark, d), ["sell", "buy", "volume"], "ts", ["key"])


@query(
    "v7_missing_counts",
    fx.sql(
        """SELECT c AS "column", CAST(n AS BIGINT) AS n_missing FROM (
        SELECT count(*) FILTER (WHERE key IS NULL) AS key, count(*) FILTER (WHERE id IS NULL) AS id,
        count(*) FILTER (WHERE ts IS NULL) AS ts, count(*) FILTER (WHERE sell IS NULL) AS sell,
        count(*) FILTER (WHERE buy IS NULL) AS buy FROM typed_quotes) UNPIVOT (n FOR c IN (key, id, ts, sell, buy))""",
        "typed_quotes",
    ),
)
def v7(spark, d):
    return quality.missing_counts(cleaning.parse_types(fx.dirty_quotes(spark, d), "ts", PRICES))


@query(
    "v8_duplicate_rows",
    """SELECT CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM (
    SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey, l_returnflag, l_shipdate)""",
)
def v8(spark, d):
    rows = readers.read_table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_shipdate")
    return quality.duplicate_rows(rows)


@query(
    "v9_negative_counts",
    fx.sql(
        """SELECT 'sell' AS "column", count(*) FILTER (WHERE sell < 0) AS n_negative FROM typed_quotes
        UNION ALL SELECT 'buy', count(*) FILTER (WHERE buy < 0) FROM typed_quotes""",
        "typed_quotes",
    ),
)
def v9(spark, d):
    return quality.negative_counts(fx.dirty_quotes(spark, d), PRICES)


def forecast_requests(spark, d):
    """Forecast requests from the event table: one per user, its events are the history."""
    e = readers.read_table(spark, d, "events")
    u = F.col("user_id")
    return e.select(
        u.alias("request_id"),
        F.floor(F.try_divide(u, F.lit(12))).alias("batch_id"),
        F.col("ts").alias("date"),
        F.when(~((u % 29 == 0) & (F.col("event_type") == "view")), F.col("value")).alias("price"),
        F.when(u % 7 != 0, u % 35 + 1).cast("int").alias("steps"),
        F.when(u % 11 != 0, F.round(F.lit(0.45) + (u % 12) * 0.05, 2)).alias("confidence"),
    )


REQUEST_SQL = """SELECT user_id AS request_id, user_id // 12 AS batch_id, ts AS date,
  CASE WHEN NOT (user_id % 29 = 0 AND event_type = 'view') THEN value END AS price,
  CAST(CASE WHEN user_id % 7 <> 0 THEN user_id % 35 + 1 END AS INTEGER) AS steps,
  CASE WHEN user_id % 11 <> 0 THEN round(0.45 + (user_id % 12) * 0.05, 2)::DOUBLE END AS confidence FROM events"""
VERDICT_SQL = """SELECT request_id, count(*) AS n_rows, count(*) FILTER (WHERE date IS NULL OR price IS NULL) AS n_incomplete,
  coalesce(max(steps), 1) AS steps, coalesce(max(confidence), 0.95) AS confidence,
  CASE WHEN count(*) < 50 THEN 'too few rows'
    WHEN count(*) FILTER (WHERE date IS NULL OR price IS NULL) > 0 THEN 'incomplete rows'
    WHEN coalesce(max(steps), 1) NOT BETWEEN 1 AND 30 THEN 'steps out of range'
    WHEN coalesce(max(confidence), 0.95) NOT BETWEEN 0.5 AND 0.99 THEN 'confidence out of range' END AS reason
  FROM requests_in GROUP BY request_id"""


@query(
    "v10_validate_requests",
    fx.sql("SELECT *, reason IS NULL AS accepted FROM verdicts", requests_in=REQUEST_SQL, verdicts=VERDICT_SQL),
)
def v10(spark, d):
    return quality.validate_requests(forecast_requests(spark, d))


@query(
    "v10_validate_batches",
    fx.sql(
        "SELECT batch_id, count(DISTINCT request_id) AS n_requests, count(DISTINCT request_id) BETWEEN 1 AND 10 AS accepted FROM requests_in GROUP BY batch_id",
        requests_in=REQUEST_SQL,
    ),
)
def v10_batches(spark, d):
    return quality.validate_batches(forecast_requests(spark, d))


@query(
    "v12_profile",
    fx.sql(
        """SELECT (SELECT count(*) FROM quotes) AS rows, CAST(4 AS BIGINT) AS columns,
        (SELECT CAST(min(ts) AS VARCHAR) FROM quotes) AS first, (SELECT CAST(max(ts) AS VARCHAR) FROM quotes) AS last,
        c AS "column", t AS type, (SELECT count(*) FROM quotes) AS present
        FROM (VALUES ('key', 'string'), ('ts', 'date'), ('sell', 'double'), ('buy', 'double')) v(c, t)""",
        "quotes",
    ),
)
def v12(spark, d):
    return quality.profile(fx.quotes(spark, d), "ts")


@query(
    "v13_quality_score",
    fx.sql(
        f"""SELECT *, (date_rate + unique_rate + present_rate + numeric_rate + sign_rate) / 5 < 0.8 AS alert,
        round((date_rate + unique_rate + present_rate + numeric_rate + sign_rate) / 5, 6) AS score FROM (
        SELECT round(1 - count(*) FILTER (WHERE TRY_CAST(ts AS TIMESTAMP) IS NULL) / n, 6) AS date_rate,
        round(1 - (SELECT count(ts) - count(DISTINCT (key, ts)) FILTER (WHERE ts IS NOT NULL) FROM typed_quotes) / n, 6) AS unique_rate,
        round(1 - (count(*) FILTER (WHERE sell IS NULL) + count(*) FILTER (WHERE buy IS NULL)) / (2 * n), 6) AS present_rate,
        round(1 - (count(*) FILTER (WHERE sell IS NOT NULL AND TRY_CAST(sell AS DOUBLE) IS NULL)
          + count(*) FILTER (WHERE buy IS NOT NULL AND TRY_CAST(buy AS DOUBLE) IS NULL)) / (2 * n), 6) AS numeric_rate,
        round(1 - (count(*) FILTER (WHERE TRY_CAST(sell AS DOUBLE) < 0) + count(*) FILTER (WHERE TRY_CAST(buy AS DOUBLE) < 0)) / (2 * n), 6) AS sign_rate
        FROM dirty_quotes, (SELECT count(*)::DOUBLE AS n FROM dirty_quotes) GROUP BY n)""",
        "typed_quotes",
    ),
)
def v13(spark, d):
    scored = quality.quality_score(fx.dirty_quotes(spark, d), PRICES, "ts", ["key"])
    return rounded(scored, 6)


# cleaning


def typed(spark, d):
    return cleaning.parse_types(fx.dirty_quotes(spark, d), "ts", PRICES)


@query(
    "c1_c2_parse_types",
    fx.sql(f"SELECT key, id, CAST(ts AS VARCHAR) AS ts, sell, buy FROM typed_quotes", "typed_quotes"),
)
def c1(spark, d):
    return fx.dated(typed(spark, d))


LAST_SQL = """SELECT key, id, ts, sell, buy FROM typed_quotes WHERE ts IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY key, ts ORDER BY id DESC) = 1"""


def _prices(source: str) -> str:
    return f"SELECT key, CAST(ts AS VARCHAR) AS ts, sell, buy FROM {source}"


@query("c3_dedup_last", fx.sql("SELECT id, " + _prices("last")[7:], "typed_quotes", last=LAST_SQL))
def c3(spark, d):
    kept = cleaning.dedup_last(typed(spark, d).where("ts is not null"), fx.RAW)
    return fx.dated(kept.select("key", "id", "ts", "sell", "buy"))


W = "PARTITION BY key ORDER BY ts"
FFILL = "last_value({0} IGNORE NULLS) OVER (" + W + " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {0}"
BFILL = "first_value({0} IGNORE NULLS) OVER (" + W + " ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {0}"


def _filled_sql(pattern: str) -> str:
    return fx.sql(_prices("f"), "gaps", f="SELECT key, ts, " + ", ".join(pattern.format(c) for c in PRICES) + " FROM gaps")


def _interpolate_sql(source: str) -> dict[str, str]:
    """CTEs that interpolate sell and buy of ``source`` by row position, as ``lerped``."""
    near = []
    for c in PRICES:
        held = f"CASE WHEN {c} IS NOT NULL THEN pos END"
        near += [
            f"max({held}) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p_{c}",
            f"min({held}) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n_{c}",
            f"last_value({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv_{c}",
            f"first_value({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv_{c}",
        ]
    lerp = ", ".join(
        f"coalesce({c}, pv_{c} + (nv_{c} - pv_{c}) * ((pos - p_{c})::DOUBLE / nullif(n_{c} - p_{c}, 0)), pv_{c}) AS {c}" for c in PRICES
    )
    return {
        "numbered": f"SELECT key, ts, sell, buy, row_number() OVER ({W}) AS pos FROM {source}",
        "near": f"SELECT *, {', '.join(near)} FROM numbered",
        "lerped": f"SELECT key, ts, {lerp} FROM near",
    }


def _fill(spark, d, strategy):
    return fx.dated(cleaning.fill(fx.gaps(spark, d), fx.QUOTE, PRICES, strategy).select("key", "ts", *PRICES))


@query("c4_forward_fill", _filled_sql(FFILL))
def c4(spark, d):
    return _fill(spark, d, "forward_fill")


@query("c5_backward_fill", _filled_sql(BFILL))
def c5(spark, d):
    return _fill(spark, d, "backward_fill")


@query("c6_interpolate", fx.sql(_prices("lerped"), "gaps", **_interpolate_sql("gaps")))
def c6(spark, d):
    return _fill(spark, d, "interpolate")


@query(
    "c7_mean_fill",
    fx.sql(
        f"SELECT key, CAST(ts AS VARCHAR) AS ts, sell AS given, {r('avg(sell) OVER (PARTITION BY key)', 4, 'filled')} FROM gaps QUALIFY sell IS NULL",
        "gaps",
    ),
)
def c7(spark, d):
    kept = fx.gaps(spark, d).select("key", "ts", "sell", F.col("sell").alias("given"))
    filled = cleaning.fill(kept, fx.QUOTE, ["sell"], "mean").where("given is null")
    return rounded(fx.dated(filled.select("key", "ts", "given", F.col("sell").alias("filled"))), 4, "filled")


@query("c8_median_fill", _filled_sql("coalesce({0}, median({0}) OVER (PARTITION BY key)) AS {0}"))
def c8(spark, d):
    return _fill(spark, d, "median")


@query("c9_drop_missing", fx.sql(_prices("gaps WHERE sell IS NOT NULL AND buy IS NOT NULL"), "gaps"))
def c9(spark, d):
    return _fill(spark, d, "drop")


IQR_SQL = ", ".join(
    f"coalesce({c} < q1_{c} - (q3_{c} - q1_{c}) * 1.5 OR {c} > q3_{c} + (q3_{c} - q1_{c}) * 1.5, false) AS {c}_outlier" for c in PRICES
)
QUARTILES = ", ".join(f"quantile_cont({c}, {p}) AS q{i}_{c}" for c in PRICES for i, p in ((1, 0.25), (3, 0.75)))
FLAG_COLUMNS = "key, CAST(ts AS VARCHAR) AS ts, sell_outlier, buy_outlier"


def _flags(spark, d, method, threshold=None):
    rows = cleaning.flag_outliers(fx.quotes(spark, d), ["key"], PRICES, method, threshold)
    return fx.dated(rows.select("key", "ts", "sell_outlier", "buy_outlier"))


@query(
    "c11_iqr_outliers",
    fx.sql(f"SELECT {FLAG_COLUMNS} FROM f", "quotes", s=f"SELECT key, {QUARTILES} FROM quotes GROUP BY key", f=f"SELECT q.*, {IQR_SQL} FROM quotes q JOIN s USING (key)"),
)
def c11(spark, d):
    return _flags(spark, d, "iqr")


def _z_sql(deviation: str, limit: float) -> str:
    tests = ", ".join(
        f"coalesce(abs(({c} - avg({c}) OVER k) / nullif({deviation}({c}) OVER k, 0)) > {limit}, false) AS {c}_outlier" for c in PRICES
    )
    return fx.sql(f"SELECT {FLAG_COLUMNS} FROM f", "quotes", f=f"SELECT *, {tests} FROM quotes WINDOW k AS (PARTITION BY key)")


@query("c12_zscore_outliers", _z_sql("stddev_samp", 2.0))
def c12(spark, d):
    return _flags(spark, d, "zscore", 2.0)


@query("c13_zscore_pop_outliers", _z_sql("stddev_pop", 3.0))
def c13(spark, d):
    return _flags(spark, d, "zscore_pop")


@query("c14_isolation_forest")
def c14(spark, d):
    rows = cleaning.flag_outliers(fx.quotes(spark, d), ["key"], ["sell"], "isolation_forest")
    return fx.dated(rows.select("key", "ts", "sell", "sell_outlier"))


def _replace_sql(source: str) -> dict[str, str]:
    return {
        "s": f"SELECT key, {QUARTILES} FROM {source} GROUP BY key",
        "flagged": f"SELECT q.*, {IQR_SQL} FROM {source} q JOIN s USING (key)",
        "blanked": "SELECT key, ts, CASE WHEN NOT sell_outlier THEN sell END AS sell, CASE WHEN NOT buy_outlier THEN buy END AS buy FROM flagged",
        **_interpolate_sql("blanked"),
    }


@query("c15_replace_outliers", fx.sql(_prices("lerped"), "quotes", **_replace_sql("quotes")))
def c15(spark, d):
    rows = cleaning.replace_outliers(fx.quotes(spark, d), fx.QUOTE, PRICES)
    return fx.dated(rows.select("key", "ts", *PRICES))


CLEAN_CTES = {
    "last": LAST_SQL,
    "filled": "SELECT key, ts, " + ", ".join(FFILL.format(c) for c in PRICES) + " FROM last",
    **_replace_sql("filled"),
}


@query("c16_clean", fx.sql(_prices("lerped"), "typed_quotes", **CLEAN_CTES))
def c16(spark, d):
    rows = cleaning.clean(fx.dirty_quotes(spark, d), fx.RAW, PRICES)
    return fx.dated(rows.select("key", "ts", *PRICES))


@query(
    "v11_cleaning_report",
    fx.sql(
        """SELECT 'initial' AS stage, m AS metric, CAST(v AS BIGINT) AS value FROM (
          SELECT count(*) AS rows, count(*) - count(sell) AS missing_sell, count(*) - count(buy) AS missing_buy FROM typed_quotes
          WHERE ts IS NOT NULL) UNPIVOT (v FOR m IN (rows, missing_sell, missing_buy))
        UNION ALL SELECT 'final', m, CAST(v AS BIGINT) FROM (
          SELECT count(*) AS rows, count(*) - count(sell) AS missing_sell, count(*) - count(buy) AS missing_buy FROM lerped)
          UNPIVOT (v FOR m IN (rows, missing_sell, missing_buy))
        UNION ALL SELECT 'cleaning', 'duplicates_removed', count(*) - count(DISTINCT (key, ts)) FROM typed_quotes WHERE ts IS NOT NULL
        UNION ALL SELECT 'cleaning', 'outliers_sell', count(*) FILTER (WHERE sell_outlier) FROM flagged
        UNION ALL SELECT 'cleaning', 'outliers_buy', count(*) FILTER (WHERE buy_outlier) FROM flagged""",
        "typed_quotes",
        **CLEAN_CTES,
    ),
)
def v11(spark, d):
    raw = settle(typed(spark, d).where("ts is not null"), "raw")
    filled = settle(cleaning.fill(cleaning.dedup_last(raw, fx.RAW), fx.RAW, PRICES), "filled")
    flagged = cleaning.flag_outliers(filled, ["key"], PRICES)
    cleaned = cleaning.replace_outliers(filled, fx.RAW, PRICES)
    return quality.cleaning_report(raw, cleaned, PRICES, ["key"], "ts", flagged)


@query("c17_drop_incomplete", fx.sql(_prices("gaps WHERE sell IS NOT NULL AND buy IS NOT NULL"), "gaps"))
def c17(spark, d):
    return fx.dated(cleaning.drop_incomplete(fx.gaps(spark, d)).select("key", "ts", *PRICES))


@query("c20_tail", fx.sql(_prices("quotes QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC) <= 7"), "supplier_quotes").replace("FROM quotes", "FROM supplier_quotes"))
def c20(spark, d):
    return fx.dated(cleaning.tail(fx.supplier_quotes(spark, d), fx.QUOTE, 7))
