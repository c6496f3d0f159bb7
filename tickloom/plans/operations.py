"""Queries: monitoring in batch and as a stream."""
from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.columns import rounded
from tickloom.operators import monitor as mon
from tickloom.operators.blocks import Series
from tickloom.plans import fixtures as fx
from tickloom.plans.registry import query, r
from tickloom.sources.readers import METRICS, read_metric_stream
from tickloom.sources.session import new_path
from tickloom.streaming import monitor as live

JOB = Series(("job",), "ts")
START = "time_bucket(INTERVAL '5 minutes', ts)"

SLIDING = """SELECT job, start, count(*) AS n FROM (SELECT job, time_bucket(INTERVAL '1 minute', ts) - to_minutes(k) AS start
  FROM requests, (SELECT range AS k FROM range(0, 5))) GROUP BY ALL"""


@query(
    "t1_request_rate",
    fx.sql(
        f"SELECT job, CAST(start AS VARCHAR) AS start, CAST(start + INTERVAL '5 minutes' AS VARCHAR) AS \"end\", n, {r('n / 300', 9, 'rate')} FROM s",
        "requests",
        s=SLIDING,
    ),
)
def t1(spark, d):
    return rounded(fx.dated(mon.request_rate(fx.requests(spark, d), ["job"])), 9)


@query(
    "t2_tumbling_rate",
    fx.sql(
        f"SELECT job, CAST({START} AS VARCHAR) AS start, CAST({START} + INTERVAL '5 minutes' AS VARCHAR) AS \"end\", count(*) AS n, {r('count(*) / 300', 9, 'rate')} FROM requests GROUP BY job, {START}",
        "requests",
    ),
)
def t2(spark, d):
    return rounded(fx.dated(mon.tumbling_rate(fx.requests(spark, d), ["job"])), 9)


@query(
    "t3_latency_quantiles",
    fx.sql(
        f"SELECT job, {r('quantile_cont(latency_ms, 0.5)', 6, 'p50')}, {r('quantile_cont(latency_ms, 0.95)', 6, 'p95')}, {r('quantile_cont(latency_ms, 0.99)', 6, 'p99')} FROM requests GROUP BY job",
        "requests",
    ),
)
def t3(spark, d):
    return rounded(mon.latency_quantiles(fx.requests(spark, d), ["job"]), 6)


BOUNDS = (5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0)


def _bucket_sql(share: float) -> str:
    return f"""(SELECT lo + (hi - lo) * (n * {share} - before) / (upto - before) FROM (SELECT *, lag(upto, 1, 0) OVER (ORDER BY hi) AS before,
      lag(hi, 1, 0) OVER (ORDER BY hi) AS lo FROM buckets b WHERE b.job = a.job) WHERE upto >= n * {share} ORDER BY hi LIMIT 1)"""


@query(
    "t4_histogram_quantile",
    fx.sql(
        f"SELECT job, {r(_bucket_sql(0.5), 6, 'p50')}, {r(_bucket_sql(0.95), 6, 'p95')} FROM (SELECT job, count(*) AS n FROM requests GROUP BY job) a",
        "requests",
        bounds=f"SELECT unnest([{', '.join(map(str, BOUNDS))}])::DOUBLE AS hi",
        buckets="SELECT job, hi, count(*) FILTER (WHERE latency_ms <= hi) AS upto FROM requests, bounds GROUP BY ALL",
    ),
)
def t4(spark, d):
    out = mon.histogram_quantile(fx.requests(spark, d), ["job"], "latency_ms", {"p50": 0.5, "p95": 0.95}, BOUNDS)
    return rounded(out, 6)


def _share_sql(share: float) -> str:
    """The first bucket that holds the rank, by a search over the window's buckets."""
    return f"""(SELECT CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (total * {share} - before) / (upto - before) END
      FROM ranked b WHERE b.job = w.job AND b.start = w.start AND total > 0 AND upto >= total * {share} ORDER BY le LIMIT 1)"""


@query(
    "t4_bucket_quantiles",
    fx.sql(
        f"SELECT job, CAST(start AS VARCHAR) AS start, {r(_share_sql(0.5), 6, 'p50')}, {r(_share_sql(0.95), 6, 'p95')} FROM (SELECT DISTINCT job, start FROM ranked) w",
        "bucket_counters",
        steps="SELECT *, value - lag(value) OVER (PARTITION BY job, le ORDER BY ts) AS step FROM bucket_counters",
        grown="""SELECT job, le, time_bucket(INTERVAL '6 hours', ts) AS start, coalesce(sum(CASE WHEN step < 0 THEN value ELSE step END), 0) AS n
          FROM steps GROUP BY ALL""",
        ranked="""SELECT *, lag(upto, 1, 0) OVER w AS before, lag(le, 1, 0) OVER w AS low, max(upto) OVER (PARTITION BY job, start) AS total
          FROM (SELECT *, max(n) OVER (PARTITION BY job, start ORDER BY le) AS upto FROM grown) WINDOW w AS (PARTITION BY job, start ORDER BY le)""",
    ),
)
def t4_buckets(spark, d):
    out = mon.bucket_quantiles(fx.bucket_counters(spark, d), JOB, {"p50": 0.5, "p95": 0.95}, window_s=21600)
    return rounded(fx.dated(out), 6)


@query(
    "t2_idle_windows",
    fx.sql(
        f"""SELECT job, CAST(start AS VARCHAR) AS start, CAST(start + INTERVAL '5 minutes' AS VARCHAR) AS "end", coalesce(n, 0) AS n, {r('coalesce(n, 0) / 300', 9, 'rate')}
        FROM (SELECT DISTINCT job FROM requests) CROSS JOIN spine LEFT JOIN counted USING (job, start)""",
        "requests",
        counted=f"SELECT job, {START} AS start, count(*) AS n FROM requests GROUP BY ALL",
        spine="SELECT unnest(generate_series((SELECT min(start) FROM counted), (SELECT max(start) FROM counted), INTERVAL '5 minutes')) AS start",
    ),
)
def t2_idle(spark, d):
    rates = mon.tumbling_rate(fx.requests(spark, d), ["job"])
    return rounded(fx.dated(mon.with_idle_windows(rates, ["job"], slide_s=mon.WINDOW_S)), 9)


@query(
    "t1_t10_idle_volume",
    fx.sql(
        f"SELECT CAST(start AS VARCHAR) AS start, coalesce(n, 0)::BIGINT AS n, {r('coalesce(n, 0) / 300', 9, 'rate')} FROM spine LEFT JOIN c USING (start) WHERE coalesce(n, 0) / 300 > 100 OR coalesce(n, 0) / 300 < 0.1",
        "requests",
        s=SLIDING,
        c="SELECT start, sum(n) AS n FROM s GROUP BY start",
        spine="SELECT unnest(generate_series((SELECT min(start) FROM c), (SELECT max(start) FROM c), INTERVAL '1 minute')) AS start",
    ),
)
def t10_idle(spark, d):
    rates = mon.with_idle_windows(mon.request_rate(fx.requests(spark, d)))
    return rounded(fx.dated(mon.unusual_volume(rates).select("start", "n", "rate")), 9)


@query(
    "t5_error_rates",
    fx.sql(
        f"""SELECT CAST({START} AS VARCHAR) AS start, {r('count(*) FILTER (WHERE status BETWEEN 400 AND 499) / 300', 9, 'rate_4xx')},
        {r('count(*) FILTER (WHERE status >= 500) / 300', 9, 'rate_5xx')}, {r('count(*) FILTER (WHERE status >= 500) / count(*)', 9, 'error_ratio')},
        count(*) FILTER (WHERE status >= 500) / count(*) > 0.05 AS high FROM requests GROUP BY {START}""",
        "requests",
    ),
)
def t5(spark, d):
    return rounded(fx.dated(mon.error_rates(fx.requests(spark, d))), 9)


@query(
    "t6_counter_rate",
    fx.sql(
        f"""SELECT job, CAST({START} AS VARCHAR) AS start, {r('coalesce(sum(CASE WHEN step < 0 THEN value ELSE step END), 0) / 300', 9, 'rate')} FROM
        (SELECT *, value - lag(value) OVER (PARTITION BY job ORDER BY ts) AS step FROM counters) GROUP BY job, {START}""",
        "counters",
    ),
)
def t6(spark, d):
    return rounded(fx.dated(mon.counter_rate(fx.counters(spark, d), JOB)), 9)


@query(
    "t6_instant_rate",
    fx.sql(
        f"""SELECT job, CAST(start AS VARCHAR) AS start, {r('CASE WHEN since >= start THEN grown / ((epoch_us(ts) - epoch_us(since)) / 1000000) END', 6, 'rate')} FROM
        (SELECT *, {START} AS start, CASE WHEN value < before THEN value ELSE value - before END AS grown, row_number() OVER (PARTITION BY job, {START} ORDER BY ts DESC) AS k FROM
        (SELECT *, lag(value) OVER w AS before, lag(ts) OVER w AS since FROM counters WINDOW w AS (PARTITION BY job ORDER BY ts))) WHERE k = 1""",
        "counters",
    ),
)
def t6_instant(spark, d):
    return rounded(fx.dated(mon.instant_rate(fx.counters(spark, d), JOB)), 6)


def samples(spark, d):
    """Metric samples per 5 minutes: error share and request rate over all jobs."""
    rates = mon.error_rates(fx.requests(spark, d)).select(F.col("start").alias("ts"), F.lit("error_ratio").alias("metric"), F.col("error_ratio").alias("value"))
    volume = mon.tumbling_rate(fx.requests(spark, d)).select(F.col("start").alias("ts"), F.lit("request_rate").alias("metric"), F.col("rate").alias("value"))
    return rates.unionByName(volume)


SAMPLE_CTES = {
    "samples": f"""SELECT {START} AS ts, 'error_ratio' AS metric, count(*) FILTER (WHERE status >= 500) / count(*) AS value FROM requests GROUP BY {START}
      UNION ALL SELECT {START}, 'request_rate', count(*) / 300 FROM requests GROUP BY {START}""",
    "rules": "SELECT * FROM (VALUES ('HighErrorRate', 'error_ratio', '>', 0.05, 120), ('UnusualPredictionVolume', 'request_rate', '>', 100, 300), ('UnusualPredictionVolume', 'request_rate', '<', 0.1, 300)) v(alert, metric, op, threshold, hold_s)",
    "tested": "SELECT *, CASE WHEN op = '>' THEN value > threshold ELSE value < threshold END AS breached FROM samples JOIN rules USING (metric)",
}


@query(
    "t7_threshold_alerts",
    fx.sql("SELECT CAST(ts AS VARCHAR) AS ts, metric, alert, op, hold_s, breached FROM tested", "requests", **SAMPLE_CTES),
)
def t7(spark, d):
    return fx.dated(mon.evaluate_rules(samples(spark, d)).select("ts", "metric", "alert", "op", "hold_s", "breached"))


@query(
    "t7_all_comparisons",
    fx.sql(
        """SELECT CAST(ts AS VARCHAR) AS ts, op, CASE op WHEN '==' THEN value = 0 WHEN '!=' THEN value <> 0 WHEN '>' THEN value > 0 WHEN '<' THEN value < 0
        WHEN '>=' THEN value >= 0 ELSE value <= 0 END AS breached FROM samples, (SELECT unnest(['==', '!=', '>', '<', '>=', '<=']) AS op) WHERE metric = 'error_ratio'""",
        "requests",
        **SAMPLE_CTES,
    ),
)
def t7_comparisons(spark, d):
    rules = [("any", "error_ratio", op, 0.0, 0, "info") for op in mon.COMPARISONS]
    return fx.dated(mon.evaluate_rules(samples(spark, d), rules).select("ts", "op", "breached"))


RULE_SERIES = Series(("alert", "op"), "ts")
HOLD_CTES = {
    "marked": "SELECT *, breached AND NOT lag(breached, 1, false) OVER (PARTITION BY alert, op ORDER BY ts) AS fresh FROM tested",
    "held": """SELECT *, CASE WHEN breached THEN last_value(CASE WHEN fresh THEN ts END IGNORE NULLS) OVER (PARTITION BY alert, op ORDER BY ts
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS since FROM marked""",
}


@query(
    "t8_hold_alerts",
    fx.sql(
        "SELECT alert, op, CAST(ts AS VARCHAR) AS ts, breached, CAST(since AS VARCHAR) AS since, coalesce(epoch(ts) - epoch(since) >= hold_s, false) AS firing FROM held",
        "requests",
        **SAMPLE_CTES,
        **HOLD_CTES,
    ),
)
def t8(spark, d):
    held = mon.hold(mon.evaluate_rules(samples(spark, d)), RULE_SERIES)
    return fx.dated(held.select("alert", "op", "ts", "breached", "since", "firing"))


@query(
    "t8_hold_until_stale",
    fx.sql(
        "SELECT alert, op, CAST(ts AS VARCHAR) AS ts, breached, CAST(since AS VARCHAR) AS since, coalesce(epoch(ts) - epoch(since) >= hold_s, false) AS firing FROM held",
        "requests",
        **SAMPLE_CTES,
        **{**HOLD_CTES, "marked": """SELECT *, breached AND (NOT lag(breached, 1, false) OVER w OR epoch(ts) - epoch(lag(ts, 1, ts) OVER w) > 600) AS fresh FROM tested
          WINDOW w AS (PARTITION BY alert, op ORDER BY ts)"""},
    ),
)
def t8_stale(spark, d):
    held = mon.hold(mon.evaluate_rules(samples(spark, d)), RULE_SERIES, stale_s=600)
    return fx.dated(held.select("alert", "op", "ts", "breached", "since", "firing"))


@query(
    "t9_absences",
    fx.sql(
        f"""SELECT job, CAST(gone_from AS VARCHAR) AS gone_from, CAST(ts AS VARCHAR) AS back_at, {r('(epoch_us(ts) - epoch_us(gone_from)) / 1000000', 6, 'seconds')} FROM
        (SELECT *, lag(ts) OVER (PARTITION BY job ORDER BY ts) AS gone_from FROM requests) WHERE epoch_us(ts) - epoch_us(gone_from) > 3600::BIGINT * 1000000""",
        "requests",
    ),
)
def t9(spark, d):
    return rounded(fx.dated(mon.absences(fx.requests(spark, d), JOB, 3600)), 6)


LOOK = "2024-01-25 00:00:00"
SERIES_SQL = "SELECT job || '/' || (client % 25) AS series, ts FROM requests"


def _many_series(spark, d):
    return fx.requests(spark, d).select(F.concat_ws("/", "job", F.pmod("client", F.lit(25)).cast("string")).alias("series"), "ts")


@query(
    "t9_absences_still_on",
    fx.sql(
        f"""SELECT series, CAST(ts AS VARCHAR) AS gone_from, CAST(back AS VARCHAR) AS back_at, {r('(epoch_us(coalesce(back, look)) - epoch_us(ts)) / 1000000', 6, 'seconds')} FROM
        (SELECT *, TIMESTAMP '{LOOK}' AS look, lead(ts) OVER (PARTITION BY series ORDER BY ts) AS back FROM series WHERE ts <= TIMESTAMP '{LOOK}')
        WHERE epoch_us(coalesce(back, look)) - epoch_us(ts) > 43200::BIGINT * 1000000""",
        "requests",
        series=SERIES_SQL,
    ),
)
def t9_still_on(spark, d):
    found = mon.absences(_many_series(spark, d), Series(("series",), "ts"), 43200, F.lit(LOOK).cast("timestamp"))
    return rounded(fx.dated(found), 6)


@query(
    "t10_unusual_volume",
    fx.sql(
        f"SELECT CAST(start AS VARCHAR) AS start, n, {r('n / 300', 9, 'rate')} FROM (SELECT start, sum(n)::BIGINT AS n FROM s GROUP BY start) WHERE n / 300 > 100 OR n / 300 < 0.1",
        "requests",
        s=SLIDING,
    ),
)
def t10(spark, d):
    return rounded(fx.dated(mon.unusual_volume(mon.request_rate(fx.requests(spark, d))).select("start", "n", "rate")), 9)


SUMMARY = {
    "n": "count(*)",
    "avg_ms": "avg(latency_ms)",
    "min_ms": "min(latency_ms)",
    "max_ms": "max(latency_ms)",
    "success_rate": "count(*) FILTER (WHERE status < 400) / count(*)",
    "throughput": "count(*) / 86400",
}
DAY = "date_trunc('day', ts)"


@query(
    "t11_response_summary",
    fx.sql(f"SELECT job, CAST({DAY}::TIMESTAMP AS VARCHAR) AS start, count(*) AS n, {', '.join(r(t, 6, n) for n, t in SUMMARY.items() if n != 'n')} FROM requests GROUP BY job, {DAY}", "requests"),
)
def t11(spark, d):
    return rounded(fx.dated(mon.response_summary(fx.requests(spark, d), ["job"], window_s=86400)), 6)


def facts(spark, d):
    """Per client: what the score and the advice need."""
    ok = F.count_if(F.col("status") < 400)
    n = F.count(F.lit(1))
    rows = fx.requests(spark, d).groupBy("client").agg(
        n.alias("n"),
        ok.alias("n_ok"),
        (n - ok).alias("n_errors"),
        (F.avg("latency_ms") * 20).alias("response_ms"),
        (F.max("latency_ms") * 10).alias("prediction_ms"),
        F.try_divide(ok, n).alias("success_rate"),
        (F.max("latency_ms") < 300).alias("batch_ok"),
        F.try_divide(n, F.lit(7.0)).alias("throughput"),
        (F.col("client") % 3 > 0).alias("metrics_available"),
    )
    return rows.withColumn("health", mon.health_status(F.col("n_ok"), F.col("n")))


FACT_CTES = {
    "facts": """SELECT *, CASE WHEN n_ok = n THEN 'healthy' WHEN n_ok > 0 THEN 'degraded' ELSE 'unhealthy' END AS health FROM (
      SELECT client, count(*) AS n, count(*) FILTER (WHERE status < 400) AS n_ok, count(*) FILTER (WHERE status >= 400) AS n_errors,
      avg(latency_ms) * 20 AS response_ms, max(latency_ms) * 10 AS prediction_ms, count(*) FILTER (WHERE status < 400) / count(*) AS success_rate,
      max(latency_ms) < 300 AS batch_ok, count(*) / 7.0::DOUBLE AS throughput, client % 3 > 0 AS metrics_available FROM requests GROUP BY client)""",
    "scored": """SELECT *, least(100, CASE health WHEN 'healthy' THEN 30 WHEN 'degraded' THEN 15 ELSE 0 END
      + CASE WHEN response_ms < 100 THEN 25 WHEN response_ms < 500 THEN 20 WHEN response_ms < 1000 THEN 15 WHEN response_ms < 2000 THEN 10 ELSE 0 END
      + success_rate * 25 + CASE WHEN batch_ok THEN CASE WHEN throughput > 10 THEN 25 ELSE 20 END ELSE 0 END) AS score FROM facts""",
}


@query("t12_health_status", fx.sql("SELECT client, n, n_ok, health FROM facts", "requests", **FACT_CTES))
def t12(spark, d):
    return facts(spark, d).select("client", "n", "n_ok", "health")


@query(
    "t13_performance_score",
    fx.sql(
        f"""SELECT client, {r('score', 6, 'score')}, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 60 THEN 'fair' ELSE 'poor' END AS band FROM scored""",
        "requests",
        **FACT_CTES,
    ),
)
def t13(spark, d):
    return rounded(mon.performance_score(facts(spark, d)).select("client", "score", "band"), 6)


@query(
    "t14_advice",
    fx.sql(
        """SELECT client, CASE WHEN advice = '' THEN 'Performance is optimal, continue monitoring' ELSE advice END AS advice FROM (SELECT client, concat_ws('; ',
        CASE WHEN health <> 'healthy' THEN 'Investigate API health issues' END,
        CASE WHEN response_ms > 1000 THEN 'Optimize API response times (currently > 1s)' WHEN response_ms > 500 THEN 'Consider optimizing API response times' END,
        CASE WHEN n_errors > 0 THEN 'Fix prediction endpoint errors' END, CASE WHEN prediction_ms > 2000 THEN 'Optimize model inference time' END,
        CASE WHEN NOT batch_ok THEN 'Fix batch prediction endpoint' END, CASE WHEN throughput < 5 THEN 'Improve batch processing throughput' END,
        CASE WHEN NOT metrics_available THEN 'Enable Prometheus metrics collection' END) AS advice FROM facts)""",
        "requests",
        **FACT_CTES,
    ),
)
def t14(spark, d):
    return mon.performance_advice(facts(spark, d)).select("client", F.array_join("advice", "; ").alias("advice"))


MIDDLE = "2024-01-16"


def _halves(spark, d):
    rows = fx.requests(spark, d).select("job", "ts", "latency_ms")
    return rows.where(F.col("ts") < MIDDLE), rows.where(F.col("ts") >= MIDDLE)


SLOT = " + ".join(f"(latency_ms > e[{i}])::INTEGER" for i in range(1, 10))


@query(
    "t15_drift_psi",
    fx.sql(
        f"""SELECT job, {r('sum((c - b) * ln(c / b))', 6, 'psi')}, sum((c - b) * ln(c / b)) > 0.1 AS drifted FROM shares GROUP BY job""",
        "requests",
        edges=f"SELECT job, quantile_cont(latency_ms, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM requests WHERE ts < TIMESTAMP '{MIDDLE}' GROUP BY job",
        slotted=f"SELECT job, {SLOT} AS slot, ts < TIMESTAMP '{MIDDLE}' AS base FROM requests JOIN edges USING (job)",
        shares="""SELECT j.job, slot, greatest(coalesce(nb, 0) / tb, 0.000001) AS b, greatest(coalesce(nc, 0) / tc, 0.000001) AS c FROM
          (SELECT job, count(*) FILTER (WHERE base) AS tb, count(*) FILTER (WHERE NOT base) AS tc FROM slotted GROUP BY job) j
          JOIN (SELECT job, slot, count(*) FILTER (WHERE base) AS nb, count(*) FILTER (WHERE NOT base) AS nc FROM slotted GROUP BY ALL) s ON j.job = s.job""",
    ),
)
def t15(spark, d):
    base, current = _halves(spark, d)
    return rounded(mon.drift_psi(base, current, ["job"], "latency_ms"), 6)


@query(
    "t15_drift_ks",
    fx.sql(
        f"""SELECT job, {r('max(abs(fb - fc))', 9, 'ks')} FROM (
        SELECT job, sum(b) OVER w / sum(b) OVER (PARTITION BY job) AS fb, sum(c) OVER w / sum(c) OVER (PARTITION BY job) AS fc FROM (
        SELECT job, latency_ms, count(*) FILTER (WHERE ts < TIMESTAMP '{MIDDLE}') AS b, count(*) FILTER (WHERE ts >= TIMESTAMP '{MIDDLE}') AS c
        FROM requests GROUP BY ALL) WINDOW w AS (PARTITION BY job ORDER BY latency_ms)) GROUP BY job""",
        "requests",
    ),
)
def t15_ks(spark, d):
    base, current = _halves(spark, d)
    return rounded(mon.drift_ks(base, current, JOB, "latency_ms"), 9)


PE = "avg(abs((y_true - y_pred) / y_true)) * 100"


@query(
    "t16_degradation",
    fx.sql(
        f"""SELECT key, CAST(period AS VARCHAR) AS period, {r('mape', 4, 'mape')}, {r('base_mape', 4, 'base_mape')}, {r('1 - mape / 100', 6, 'accuracy')},
        mape > base_mape * 1.2 AS degraded, 1 - mape / 100 < 0.7 AS alert FROM
        (SELECT key, CAST(date_trunc('month', ts) AS DATE) AS period, {PE} AS mape FROM predictions WHERE ts >= DATE '1998-01-01' GROUP BY ALL)
        JOIN (SELECT key, {PE} AS base_mape FROM predictions WHERE ts < DATE '1998-01-01' GROUP BY key) USING (key)""",
        "predictions",
    ),
)
def t16(spark, d):
    out = mon.degradation(fx.predictions(spark, d), ["key"], "ts", F.lit("1998-01-01").cast("date"))
    return rounded(rounded(fx.dated(out), 4, "mape", "base_mape"), 6, "accuracy")


# streams

PARTS = 5


def _request_files(spark, rows, schema, label):
    """The rows as a few parquet files written in time order, as a scraper would leave them."""
    path = new_path(spark, label)
    ends = rows.agg(F.unix_micros(F.min("ts")).alias("lo"), F.unix_micros(F.max("ts")).alias("hi")).first()
    width = (ends.hi - ends.lo) // PARTS + 1
    part = F.floor(F.try_divide(F.unix_micros("ts") - ends.lo, F.lit(width)))
    named = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields], part.alias("_part"))
    for i in range(PARTS):
        named.where(F.col("_part") == i).drop("_part").write.mode("append").parquet(path)
    return path


def _streamed(spark, stream, label):
    out = new_path(spark, label)
    live.run_available(stream, out, new_path(spark, f"{label}-progress"))
    return spark.read.parquet(out)


@query(
    "s12_t17_stream_windows",
    fx.sql(
        f"""SELECT job, CAST(start AS VARCHAR) AS start, count(*) AS n, {r('count(*) / 300', 9, 'rate')}, {r('avg(latency_ms)', 6, 'avg_ms')},
        max(latency_ms) AS max_ms, {r('count(*) FILTER (WHERE status >= 500) / count(*)', 6, 'error_ratio')}, count(*) / 300 > 100 OR count(*) / 300 < 0.1 AS unusual FROM
        (SELECT *, time_bucket(INTERVAL '1 minute', ts) - to_minutes(k) AS start FROM requests, (SELECT range AS k FROM range(0, 5)))
        WHERE start + INTERVAL '5 minutes' <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL '10 minutes' FROM requests) GROUP BY job, start""",
        "requests",
    ),
)
def t17(spark, d):
    path = _request_files(spark, fx.requests(spark, d), METRICS, "requests")
    stream = live.windowed_requests(read_metric_stream(spark, path))
    out = _streamed(spark, stream, "windows")
    return rounded(rounded(fx.dated(out.select("job", "start", "n", "rate", "avg_ms", "max_ms", "error_ratio", "unusual")), 9, "rate"), 6, "avg_ms", "error_ratio")


def _with_rocksdb(spark, work):
    before = spark.conf.get(live.STORE_SETTING)
    spark.conf.set(live.STORE_SETTING, live.ROCKSDB)
    try:
        return work()
    finally:
        spark.conf.set(live.STORE_SETTING, before)


@query(
    "t8_stream_hold_alerts",
    fx.sql(
        "SELECT alert, op AS series, CAST(ts AS VARCHAR) AS ts, CAST(since AS VARCHAR) AS since, coalesce(epoch(ts) - epoch(since) >= hold_s, false) AS firing FROM held",
        "requests",
        **SAMPLE_CTES,
        **HOLD_CTES,
    ),
)
def t8_stream(spark, d):
    tested = mon.evaluate_rules(samples(spark, d)).select("alert", F.col("op").alias("series"), "ts", "breached", "hold_s")
    path = _request_files(spark, tested, tested.schema, "tested")
    stream = live.held_alerts(read_metric_stream(spark, path, tested.schema))
    return _with_rocksdb(spark, lambda: fx.dated(_streamed(spark, stream, "held")))


@query(
    "t9_stream_absences",
    fx.sql(
        """SELECT series, CAST(ts AS VARCHAR) AS gone_from, CAST(ts + INTERVAL 1 DAY AS VARCHAR) AS detected_at FROM
        (SELECT *, lead(ts) OVER (PARTITION BY series ORDER BY ts) AS back FROM series)
        WHERE (back IS NULL OR back > ts + INTERVAL 1 DAY) AND ts + INTERVAL 1 DAY < (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM series)""",
        "requests",
        series=SERIES_SQL,
    ),
)
def t9_stream(spark, d):
    rows = _many_series(spark, d)
    path = _request_files(spark, rows, rows.schema, "series")
    stream = live.missing_series(read_metric_stream(spark, path, rows.schema), 86400)
    return fx.dated(_streamed(spark, stream, "missing"))
