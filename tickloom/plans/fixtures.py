"""Series derived from the given tables, as DataFrames and as the same SQL.

Sums go through DECIMAL so that both engines see identical inputs (four places where a price is
multiplied by a discount, so that no product lies on a rounding edge).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators import indicators, lags
from tickloom.operators.blocks import Series, add_features
from tickloom.sources.readers import read_table

QUOTE = Series(("key",), "ts")
RAW = Series(("key",), "ts", ("id",))


def _money(c: Column, scale: int = 2) -> Column:
    return F.sum(c.cast(f"decimal(18,{scale})")).cast("double")


def _vwap(df: DataFrame, key: str) -> DataFrame:
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    return df.groupBy(F.col(key).cast("string").alias("key"), F.to_date("l_shipdate").alias("ts")).agg(
        F.try_divide(_money(price), _money(quantity)).alias("sell"),
        F.try_divide(_money(price * (1 - F.col("l_discount")), 4), _money(quantity)).alias("buy"),
    )


def quotes(spark: SparkSession, d: str) -> DataFrame:
    """Daily price per return flag."""
    return _vwap(read_table(spark, d, "lineitem"), "l_returnflag")


def supplier_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Daily price per supplier: many short series, growing with the data."""
    return _vwap(read_table(spark, d, "lineitem"), "l_suppkey")


def order_quotes(spark: SparkSession, d: str) -> DataFrame:
    return (
        read_table(spark, d, "orders")
        .groupBy(F.col("o_orderpriority").alias("key"), F.to_date("o_orderdate").alias("ts"))
        .agg(F.try_divide(_money(F.col("o_totalprice")), F.count(F.lit(1))).alias("sell"))
    )


def _day(ts: str = "ts"):
    return F.datediff(ts, F.lit("1970-01-01").cast("date"))


def dirty_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Text quotes with planted faults: gaps, junk, signs, spikes, repeated and unreadable dates."""
    q = quotes(spark, d).withColumn("d", _day())
    sell, day = F.col("sell"), F.col("d")
    text = (
        F.when(day % 17 == 0, F.lit(None))
        .when(day % 19 == 0, "n/a")
        .when(day % 23 == 0, (-sell).cast("string"))
        .when(day % 29 == 0, (sell * 20).cast("string"))
        .otherwise(sell.cast("string"))
    )
    first = q.select(
        "key",
        F.concat_ws("-", "key", day.cast("string"), F.lit("a")).alias("id"),
        F.when(day % 211 == 0, "not a date").otherwise(F.concat(F.col("ts").cast("string"), F.lit(" 00:00:00"))).alias("ts"),
        text.alias("sell"),
        F.when(day % 37 != 0, F.col("buy").cast("string")).alias("buy"),
    )
    again = q.where(day % 31 == 0).select(
        "key",
        F.concat_ws("-", "key", day.cast("string"), F.lit("b")).alias("id"),
        F.concat(F.col("ts").cast("string"), F.lit(" 00:00:00")).alias("ts"),
        (sell * 1.5).cast("string").alias("sell"),
        F.col("buy").cast("string").alias("buy"),
    )
    return first.unionByName(again)


def gaps(spark: SparkSession, d: str) -> DataFrame:
    """Quotes with gaps inside, at the start and at the end."""
    day = _day()
    hole = (day % 7).isin(1, 2) | (F.col("ts") <= F.lit("1995-01-20").cast("date")) | (F.col("ts") >= F.lit("2001-09-20").cast("date"))
    return quotes(spark, d).withColumns({"sell": F.when(~hole, F.col("sell")), "buy": F.when(day % 11 != 0, F.col("buy"))})


def sparse_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Quotes of sixty days, then none for four hundred, again and again."""
    return quotes(spark, d).withColumn("sell", F.when(_day() % 460 < 60, F.col("sell")))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """The price before as forecast."""
    lagged = add_features(quotes(spark, d), QUOTE, lags.lags(["sell"], [1]))
    return lagged.where("sell_lag_1 is not null").select("key", "ts", F.col("sell").alias("y_true"), F.col("sell_lag_1").alias("y_pred"))


def models(spark: SparkSession, d: str) -> DataFrame:
    """Three forecasts of the same prices: naive, 5-day and 20-day mean, each one row behind."""
    wide = add_features(quotes(spark, d), QUOTE, indicators.sma("sell", (5, 20)), lags.lags(["sell", "sma_5", "sma_20"], [1]))
    named = {"naive": "sell_lag_1", "sma_5": "sma_5_lag_1", "sma_20": "sma_20_lag_1"}
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("y_pred")) for m, c in named.items()])
    return wide.select("key", "ts", F.col("sell").alias("y_true"), F.inline(rows)).where("y_pred is not null")


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Request log from the event table."""
    e = read_table(spark, d, "events")
    return e.select(
        "ts",
        F.col("event_type").alias("job"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.col("value").alias("latency_ms"),
        F.col("user_id").alias("client"),
    )


def counters(spark: SparkSession, d: str) -> DataFrame:
    """A counter per job that starts again on the hour: (job, ts, value), one sample per event."""
    return requests(spark, d).select(
        "job", "ts", (F.minute("ts") * 60 + F.second("ts")).cast("double").alias("value")
    )


LATENCY_BOUNDS = (5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, float("inf"))


def bucket_counters(spark: SparkSession, d: str) -> DataFrame:
    """Requests up to each latency bound since midnight, sampled by the hour: (job, le, ts, value). Counters start again every day."""
    hour = F.date_trunc("hour", "ts").alias("ts")
    upto = [F.struct(F.lit(b).alias("le"), F.count_if(F.col("latency_ms") <= b).alias("n")) for b in LATENCY_BOUNDS]
    hours = requests(spark, d).groupBy("job", hour).agg(F.array(*upto).alias("b")).select("job", "ts", F.inline("b"))
    so_far = Window.partitionBy("job", "le", F.to_date("ts")).orderBy("ts")  # 24 rows at most
    return hours.select("job", "le", "ts", F.sum("n").over(so_far).cast("double").alias("value"))


def history(spark: SparkSession, d: str) -> DataFrame:
    """Training-history shape: one run per priority and status, one epoch per order month."""
    epoch = F.months_between(F.trunc("o_orderdate", "month"), F.lit("1995-01-01").cast("date")).cast("int") + 1
    run = F.concat_ws("/", "o_orderpriority", "o_orderstatus")
    return (
        read_table(spark, d, "orders")
        .groupBy(run.alias("run_id"), epoch.alias("epoch"))
        .agg(
            F.try_divide(_money(F.col("o_totalprice")), F.count(F.lit(1))).alias("loss"),
            F.max("o_totalprice").alias("val_loss"),
        )
    )


_SUM = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"
_SUM4 = "CAST(sum(CAST({} AS DECIMAL(18,4))) AS DOUBLE)"


def _vwap_sql(key: str) -> str:
    price, quantity = _SUM.format("l_extendedprice"), _SUM.format("l_quantity")
    net = _SUM4.format("l_extendedprice * (1 - l_discount)")
    return f"""SELECT CAST({key} AS VARCHAR) AS key, CAST(l_shipdate AS DATE) AS ts,
      {price} / {quantity} AS sell, {net} / {quantity} AS buy FROM lineitem GROUP BY ALL"""


_DAY = "date_diff('day', DATE '1970-01-01', ts)"
_HOLE = f"({_DAY} % 7 IN (1, 2) OR ts <= DATE '1995-01-20' OR ts >= DATE '2001-09-20')"

FIXTURE_SQL = {
    "quotes": ((), _vwap_sql("l_returnflag")),
    "supplier_quotes": ((), _vwap_sql("l_suppkey")),
    "order_quotes": (
        (),
        f"""SELECT o_orderpriority AS key, CAST(o_orderdate AS DATE) AS ts,
        {_SUM.format('o_totalprice')} / count(*) AS sell FROM orders GROUP BY ALL""",
    ),
    "dirty_quotes": (
        ("quotes",),
        f"""SELECT key, key || '-' || d || '-a' AS id,
        CASE WHEN d % 211 = 0 THEN 'not a date' ELSE CAST(ts AS VARCHAR) || ' 00:00:00' END AS ts,
        CASE WHEN d % 17 = 0 THEN NULL WHEN d % 19 = 0 THEN 'n/a' WHEN d % 23 = 0 THEN CAST(-sell AS VARCHAR)
          WHEN d % 29 = 0 THEN CAST(sell * 20 AS VARCHAR) ELSE CAST(sell AS VARCHAR) END AS sell,
        CASE WHEN d % 37 <> 0 THEN CAST(buy AS VARCHAR) END AS buy
        FROM (SELECT *, {_DAY} AS d FROM quotes)
        UNION ALL
        SELECT key, key || '-' || d || '-b', CAST(ts AS VARCHAR) || ' 00:00:00', CAST(sell * 1.5 AS VARCHAR),
        CAST(buy AS VARCHAR) FROM (SELECT *, {_DAY} AS d FROM quotes) WHERE d % 31 = 0""",
    ),
    "typed_quotes": (
        ("dirty_quotes",),
        """SELECT key, id, TRY_CAST(ts AS TIMESTAMP) AS ts, TRY_CAST(sell AS DOUBLE) AS sell,
        TRY_CAST(buy AS DOUBLE) AS buy FROM dirty_quotes""",
    ),
    "gaps": (
        ("quotes",),
        f"""SELECT key, ts, CASE WHEN NOT {_HOLE} THEN sell END AS sell,
        CASE WHEN {_DAY} % 11 <> 0 THEN buy END AS buy FROM quotes""",
    ),
    "sparse_quotes": (("quotes",), f"SELECT key, ts, CASE WHEN {_DAY} % 460 < 60 THEN sell END AS sell, buy FROM quotes"),
    "predictions": (
        ("quotes",),
        """SELECT * FROM (SELECT key, ts, sell AS y_true, lag(sell) OVER (PARTITION BY key ORDER BY ts) AS y_pred
        FROM quotes) WHERE y_pred IS NOT NULL""",
    ),
    "models": (
        ("quotes",),
        """SELECT model, key, ts, y_true, y_pred FROM (
          SELECT key, ts, sell AS y_true, lag(sell) OVER w AS naive, lag(s5) OVER w AS sma_5, lag(s20) OVER w AS sma_20
          FROM (SELECT key, ts, sell,
            CASE WHEN count(sell) OVER w5 = 5 THEN avg(sell) OVER w5 END AS s5,
            CASE WHEN count(sell) OVER w20 = 20 THEN avg(sell) OVER w20 END AS s20 FROM quotes
            WINDOW w5 AS (PARTITION BY key ORDER BY ts ROWS 4 PRECEDING),
            w20 AS (PARTITION BY key ORDER BY ts ROWS 19 PRECEDING))
          WINDOW w AS (PARTITION BY key ORDER BY ts))
        UNPIVOT (y_pred FOR model IN (naive, sma_5, sma_20))""",
    ),
    "requests": (
        (),
        """SELECT ts, event_type AS job, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
        value AS latency_ms, user_id AS client FROM events""",
    ),
    "counters": (
        ("requests",),
        """SELECT job, ts, CAST(minute(ts) * 60 + second(ts) AS DOUBLE) AS value FROM requests""",
    ),
    "bucket_counters": (
        ("requests",),
        f"""SELECT job, le, ts, CAST(sum(n) OVER (PARTITION BY job, le, CAST(ts AS DATE) ORDER BY ts) AS DOUBLE) AS value FROM (
          SELECT job, le, date_trunc('hour', ts) AS ts, count(*) FILTER (WHERE latency_ms <= le) AS n
          FROM requests, (SELECT unnest([{', '.join(f"'{b}'::DOUBLE" for b in LATENCY_BOUNDS)}]) AS le) GROUP BY ALL)""",
    ),
    "history": (
        (),
        f"""SELECT o_orderpriority || '/' || o_orderstatus AS run_id,
        CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INTEGER) AS epoch,
        {_SUM.format('o_totalprice')} / count(*) AS loss, max(o_totalprice) AS val_loss FROM orders GROUP BY ALL""",
    ),
}


def sql(body: str, *names: str, **more: str) -> str:
    """``body`` with the named fixtures, and then the given extra tables, in front as CTEs."""
    needed: dict[str, str] = {}

    def need(name: str) -> None:
        before, text = FIXTURE_SQL[name]
        for other in before:
            need(other)
        needed.setdefault(name, text)

    for name in names:
        need(name)
    needed.update(more)
    tables = ",\n".join(f"{name} AS ({text})" for name, text in needed.items())
    return f"WITH {tables}\n{body}"


def dated(df: DataFrame) -> DataFrame:
    """Dates and timestamps as text, for output."""
    kinds = (T.DateType, T.TimestampType)
    return df.withColumns({f.name: F.col(f.name).cast("string") for f in df.schema.fields if isinstance(f.dataType, kinds)})
