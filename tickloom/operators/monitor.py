"""Monitoring over request logs, counters and gauges, as batch tables."""
from __future__ import annotations

import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import ladder, notes, ratio
from tickloom.operators.blocks import Feature, Series, add_features, attach, running
from tickloom.operators.quantiles import quantiles
from tickloom.sources.session import settle

# Windows in seconds and rule bounds.
WINDOW_S, SLIDE_S = 300, 60
ERROR_RATIO = 0.05
VOLUME_HIGH, VOLUME_LOW = 100.0, 0.1
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
LATENCY_SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
DRIFT_LIMIT = 0.1
ACCURACY_LIMIT = 0.7
# Alert rules as (alert, metric, op, threshold, hold in seconds, severity).
RULES = (
    ("APIDown", "up_api", "==", 0.0, 30, "critical"),
    ("HighResponseTime", "latency_p95_s", ">", 2.0, 120, "warning"),
    ("HighErrorRate", "error_ratio", ">", 0.05, 120, "warning"),
    ("PredictionAccuracyLow", "model_prediction_accuracy", "<", 0.7, 300, "warning"),
    ("ModelInferenceTimeHigh", "inference_p95_s", ">", 5.0, 120, "warning"),
    ("HighMemoryUsage", "memory_used_ratio", ">", 0.85, 120, "warning"),
    ("HighCPUUsage", "cpu_used_pct", ">", 80.0, 300, "warning"),
    ("DiskSpaceLow", "disk_free_pct", "<", 10.0, 120, "critical"),
    ("PostgreSQLDown", "up_postgres", "==", 0.0, 30, "critical"),
    ("PostgreSQLTooManyConnections", "pg_connections", ">", 80.0, 120, "warning"),
    ("RedisDown", "up_redis", "==", 0.0, 30, "warning"),
    ("RedisHighMemoryUsage", "redis_memory_ratio", ">", 0.9, 120, "warning"),
    ("MLflowDown", "up_mlflow", "==", 0.0, 60, "warning"),
    ("ContainerHighCPU", "container_cpu_pct", ">", 80.0, 120, "warning"),
    ("ContainerHighMemory", "container_memory_ratio", ">", 0.8, 120, "warning"),
    ("UnusualPredictionVolume", "request_rate", ">", 100.0, 300, "info"),
    ("UnusualPredictionVolume", "request_rate", "<", 0.1, 300, "info"),
    ("ModelDriftDetected", "model_drift_score", ">", 0.1, 300, "warning"),
    ("DataQualityIssue", "data_quality_score", "<", 0.8, 120, "warning"),
)


def _bucket(ts: str, seconds: int) -> Column:
    return F.window(ts, f"{seconds} seconds")["start"]


def is_error(status: Column, digit: str = "5") -> Column:
    return status.cast("string").startswith(digit)


def request_rate(
    df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", window_s: int = WINDOW_S, slide_s: int = SLIDE_S
) -> DataFrame:
    """Requests per second over sliding windows: (keys, start, end, n, rate).

    Rows are counted per slide step first; only those counts are spread over the windows that
    contain them.
    """
    if window_s % slide_s:
        raise ValueError("the window must be a multiple of the slide")
    steps = df.groupBy(*keys, _bucket(ts, slide_s).alias("_step")).agg(F.count(F.lit(1)).alias("_n"))
    starts = F.sequence(F.lit(0), F.lit(window_s // slide_s - 1))
    spread = steps.withColumn("_k", F.explode(starts)).withColumn(
        "start", F.col("_step") - F.make_dt_interval(secs=F.col("_k") * slide_s)
    )
    counted = spread.groupBy(*keys, "start").agg(F.sum("_n").alias("n"))
    return counted.select(
        *keys,
        "start",
        (F.col("start") + F.make_dt_interval(secs=F.lit(window_s))).alias("end"),
        "n",
        ratio("n", F.lit(window_s)).alias("rate"),
    )


#: Windows that a row of the spine stands for before it is spread.
SPINE_STEP = 1000


def with_idle_windows(rates: DataFrame, keys: Sequence[str] = (), window_s: int = WINDOW_S, slide_s: int = SLIDE_S) -> DataFrame:
    """``rates`` (keys, start, end, n, rate) with a row of none for every window without requests.

    Each key gets all windows from the first to the last of any key, so that a key that has stopped is seen. Keys compare null-safe.
    """
    rates = settle(rates, "rates")
    ends = rates.agg(F.min("start").alias("lo"), F.max("start").alias("hi")).first()
    if ends.lo is None:
        return rates
    step, leap = F.make_dt_interval(secs=F.lit(slide_s)), F.make_dt_interval(secs=F.lit(slide_s * SPINE_STEP))
    hi = F.lit(ends.hi)
    spine = rates.select(*keys).distinct() if keys else rates.limit(1).select()
    spine = spine.withColumn("_leap", F.explode(F.sequence(F.lit(ends.lo), hi, leap)))
    spine = spine.withColumn("_start", F.explode(F.sequence("_leap", F.least(F.col("_leap") + leap - step, hi), step))).drop("_leap")
    names = {k: f"_r_{k}" for k in keys}
    same = F.col("start") == F.col("_start")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(names[k]))
    out = rates.join(spine.withColumnsRenamed(names), same, "right")
    return out.select(
        *[F.col(names[k]).alias(k) for k in keys],
        F.col("_start").alias("start"),
        (F.col("_start") + F.make_dt_interval(secs=F.lit(window_s))).alias("end"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("rate", F.lit(0.0)).alias("rate"),
    )


def tumbling_rate(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", window_s: int = WINDOW_S) -> DataFrame:
    return request_rate(df, keys, ts, window_s, window_s)


def latency_quantiles(df: DataFrame, keys: Sequence[str], value: str = "latency_ms", approx: bool = False) -> DataFrame:
    return quantiles(df, keys, {name: (value, p) for name, p in LATENCY_SHARES.items()}, approx=approx)


def histogram_quantile(
    df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], bounds: Sequence[float] = LATENCY_BOUNDS
) -> DataFrame:
    """Quantiles from bucket counts, linear inside a bucket; beyond the last bound that bound is given."""
    counted = df.groupBy(*keys).agg(
        F.count(value).alias("_all"),
        *[F.count_if(F.col(value) <= b).alias(f"_c{i}") for i, b in enumerate(bounds)],
    )

    def at(share: float) -> Column:
        rank = F.col("_all") * share
        out = None
        for i, upper in enumerate(bounds):
            below = F.col(f"_c{i - 1}") if i else F.lit(0)
            lower = bounds[i - 1] if i else 0.0
            value_here = F.lit(lower) + F.try_divide(rank - below, F.col(f"_c{i}") - below) * (upper - lower)
            test = F.col(f"_c{i}") >= rank
            out = F.when(test, value_here) if out is None else out.when(test, value_here)
        return F.when(F.col("_all") > 0, out.otherwise(F.lit(bounds[-1])))

    return counted.select(*keys, *[at(p).alias(name) for name, p in shares.items()])


def bucket_quantiles(
    df: DataFrame, s: Series, shares: dict[str, float], le: str = "le", value: str = "value", window_s: int = WINDOW_S
) -> DataFrame:
    """Quantiles from cumulative bucket counters: (keys, start, a column per share) for each tumbling window.

    A sample of a series says how many observations up to the bound ``le`` it has seen; the last bound is infinity. Each bucket's increase
    within a window is taken with resets of its counter corrected. A quantile is linear inside its bucket, the first of which begins at 0; beyond
    the last finite bound that bound is given. Windows without observations or without the infinite bucket give null.
    """
    buckets = Series((*s.keys, le), s.ts, s.tie, s.block_rows)
    grown = counter_increase(df.where(F.col(le).isNotNull() & F.col(value).isNotNull()), buckets, value)
    cell = [*s.keys, "start"]
    counted = grown.groupBy(*s.keys, _bucket(s.ts, window_s).alias("start"), F.col(le).alias("_le")).agg(F.coalesce(F.sum("increase"), F.lit(0.0)).alias("_n"))
    by_bound = Window.partitionBy(*cell).orderBy("_le")  # a row for each bound
    # a bucket scraped a moment before a larger one may have seen more
    counted = counted.withColumn("_upto", F.max("_n").over(by_bound.rowsBetween(Window.unboundedPreceding, 0)))
    counted = counted.withColumns(
        {
            "_before": F.lag("_upto", 1, 0.0).over(by_bound),
            "_low": F.lag("_le", 1, 0.0).over(by_bound),
            "_all": F.max(F.when(F.col("_le") == float("inf"), F.col("_upto"))).over(Window.partitionBy(*cell)),
        }
    )

    def at(share: float) -> Column:
        rank = F.col("_all") * share
        inside = F.col("_low") + (F.col("_le") - F.col("_low")) * F.try_divide(rank - F.col("_before"), F.col("_upto") - F.col("_before"))
        here = F.when(F.col("_le") == float("inf"), F.col("_low")).when(F.col("_le") <= 0, F.col("_le")).otherwise(F.coalesce(inside, "_le"))
        return F.min_by(F.when(F.col("_all") > 0, here), F.when(F.col("_upto") >= rank, F.col("_le")))

    return counted.groupBy(*cell).agg(*[at(p).alias(name) for name, p in shares.items()])


def error_rates(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", window_s: int = WINDOW_S) -> DataFrame:
    """4xx and 5xx per second, the 5xx share, and whether it is too high, per tumbling window."""
    server, client = F.count_if(is_error(F.col("status"))), F.count_if(is_error(F.col("status"), "4"))
    out = df.groupBy(*keys, _bucket(ts, window_s).alias("start")).agg(
        ratio(client, F.lit(window_s)).alias("rate_4xx"),
        ratio(server, F.lit(window_s)).alias("rate_5xx"),
        ratio(server, F.count(F.lit(1))).alias("error_ratio"),
    )
    return out.withColumn("high", F.col("error_ratio") > ERROR_RATIO)


def counter_increase(df: DataFrame, s: Series, value: str = "value") -> DataFrame:
    """Add ``increase`` since the sample before; after a reset the value itself counts."""

    def build(rows: DataFrame, s: Series) -> DataFrame:
        step = F.col(value) - F.lag(value).over(s.window())
        return rows.withColumn("increase", F.when(step < 0, F.col(value)).otherwise(step))

    return add_features(df, s, Feature(1, build))


def counter_rate(df: DataFrame, s: Series, value: str = "value", window_s: int = WINDOW_S) -> DataFrame:
    """Increase of a counter per second in tumbling windows."""
    return (
        counter_increase(df, s, value)
        .groupBy(*s.keys, _bucket(s.ts, window_s).alias("start"))
        .agg(ratio(F.coalesce(F.sum("increase"), F.lit(0.0)), F.lit(window_s)).alias("rate"))
    )


def instant_rate(df: DataFrame, s: Series, value: str = "value", window_s: int = WINDOW_S) -> DataFrame:
    """Rate between the last two samples of each tumbling window; null where it has only one."""

    def build(rows: DataFrame, s: Series) -> DataFrame:
        return rows.withColumn("_since", F.lag(s.ts).over(s.window()))

    start = _bucket(s.ts, window_s)
    rows = add_features(counter_increase(df, s, value), s, Feature(1, build)).withColumn("start", start)
    seconds = (F.unix_micros(s.ts) - F.unix_micros("_since")) / 1_000_000
    rate = F.when(F.col("_since") >= F.col("start"), F.try_divide(F.col("increase"), seconds))
    return rows.groupBy(*s.keys, "start").agg(F.max_by(F.struct(rate.alias("rate")), F.struct(s.ts, *s.tie)).alias("_last")).select(*s.keys, "start", F.col("_last.rate").alias("rate"))


#: Rules that travel with the plan at most; how longer lists are joined is left to Spark.
BROADCAST_RULES = 10_000
COMPARISONS = {"==": operator.eq, "!=": operator.ne, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}


def evaluate_rules(df: DataFrame, rules: Sequence[tuple] = RULES) -> DataFrame:
    """Metric samples (.., metric, value) beside every rule on their metric, with ``breached``.

    Rules compare by ==, !=, >, <, >= or <=; a null value breaches none and gives null.
    """
    unknown = sorted({rule[2] for rule in rules} - set(COMPARISONS))
    if unknown:
        raise ValueError(f"unknown comparison: {', '.join(unknown)}")
    schema = "alert string, metric string, op string, threshold double, hold_s int, severity string"
    table = df.sparkSession.createDataFrame(list(rules), schema)
    if len(rules) <= BROADCAST_RULES:
        table = F.broadcast(table)
    test = F.lit(None).cast("boolean")
    for name, compare in COMPARISONS.items():
        test = F.when(F.col("op") == name, compare(F.col("value"), F.col("threshold"))).otherwise(test)
    return df.join(table, "metric").withColumn("breached", test)


def hold(df: DataFrame, s: Series, breached: str = "breached", hold_s: str | int = "hold_s", stale_s: int | None = None) -> DataFrame:
    """Add ``since`` (start of the current breach) and ``firing`` (breached for the hold time).

    With ``stale_s`` a breach also ends where no sample comes for longer than that; the next one starts anew.
    """

    def mark(rows: DataFrame, s: Series) -> DataFrame:
        before = F.coalesce(F.lag(breached).over(s.window()), F.lit(False))
        if stale_s is not None:
            gone = F.unix_micros(s.ts) - F.unix_micros(F.lag(s.ts).over(s.window())) > stale_s * 1_000_000
            before = before & ~F.coalesce(gone, F.lit(False))
        fresh = F.col(breached) & ~before
        return rows.withColumn("_began", F.when(fresh, F.col(s.ts)))

    marked = running(add_features(df, s, Feature(1, mark)), s, {"_run": ("last", "_began")})
    limit = F.col(hold_s) if isinstance(hold_s, str) else F.lit(hold_s)
    since = F.when(F.col(breached), F.col("_run.value"))
    held = F.unix_micros(s.ts) - F.unix_micros(since) >= limit * 1_000_000
    return marked.withColumns({"since": since, "firing": F.coalesce(held, F.lit(False))}).drop("_began", "_run")


def absences(df: DataFrame, s: Series, limit_s: int, until=None) -> DataFrame:
    """Stretches without a sample longer than ``limit_s`` seconds: (keys, gone_from, back_at, seconds).

    With ``until``, the time of the look, a series whose last sample is longer ago than the limit is gone still: its
    ``back_at`` is null and ``seconds`` count up to then; later samples are left out.
    """
    df = df.select(*s.keys, s.ts, *s.tie)
    if until is not None:
        df = df.where(F.col(s.ts) <= until)

    def build(rows: DataFrame, s: Series) -> DataFrame:
        return rows.withColumn("gone_from", F.lag(s.ts).over(s.window()))

    gaps = add_features(df, s, Feature(1, build)).select(*s.keys, "gone_from", F.col(s.ts).alias("back_at"))
    if until is not None:
        last = df.groupBy(*s.keys).agg(F.max(s.ts).alias("gone_from"))
        gaps = gaps.unionByName(last.withColumn("back_at", F.lit(None).cast(df.schema[s.ts].dataType)))
    end = F.col("back_at") if until is None else F.coalesce("back_at", until)
    seconds = F.try_divide(F.unix_micros(end) - F.unix_micros("gone_from"), F.lit(1_000_000))
    return gaps.withColumn("seconds", seconds).where(F.col("seconds") > limit_s)


def unusual_volume(rates: DataFrame) -> DataFrame:
    return rates.where((F.col("rate") > VOLUME_HIGH) | (F.col("rate") < VOLUME_LOW))


def response_summary(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", window_s: int = WINDOW_S) -> DataFrame:
    """Mean, lowest and highest latency, success rate and throughput per window."""
    ok = F.count_if(~is_error(F.col("status")) & ~is_error(F.col("status"), "4"))
    n = F.count(F.lit(1))
    return df.groupBy(*keys, _bucket(ts, window_s).alias("start")).agg(
        n.alias("n"),
        F.avg("latency_ms").alias("avg_ms"),
        F.min("latency_ms").alias("min_ms"),
        F.max("latency_ms").alias("max_ms"),
        ratio(ok, n).alias("success_rate"),
        ratio(n, F.lit(window_s)).alias("throughput"),
    )


def health_status(n_ok: Column, n_all: Column) -> Column:
    return F.when(n_ok == n_all, "healthy").when(n_ok > 0, "degraded").otherwise("unhealthy")


def performance_score(df: DataFrame) -> DataFrame:
    """Score 0 to 100 and its band, from health, latency, success rate and batch throughput."""
    # The points of each part, and the least score of each band.
    health = F.when(F.col("health") == "healthy", 30.0).when(F.col("health") == "degraded", 15.0).otherwise(0.0)
    ms = F.col("response_ms")
    speed = F.when(ms < 100, 25.0).when(ms < 500, 20.0).when(ms < 1000, 15.0).when(ms < 2000, 10.0).otherwise(0.0)
    success = F.coalesce(F.col("success_rate"), F.lit(0.0)) * 25
    batch = F.when(F.col("batch_ok"), F.when(F.col("throughput") > 10, 25.0).otherwise(20.0)).otherwise(0.0)
    out = df.withColumn("score", F.least(F.lit(100.0), health + speed + success + batch))
    at_least = F.when(F.col("score") >= 90, "excellent").when(F.col("score") >= 75, "good").when(F.col("score") >= 60, "fair")
    return out.withColumn("band", at_least.otherwise("poor"))


def performance_advice(df: DataFrame) -> DataFrame:
    """Advice texts from the same facts (``prediction_ms`` and ``n_errors`` of predictions included)."""
    ms = F.col("response_ms")
    # Bounds and texts.
    texts = notes(
        (F.col("health") != "healthy", "Investigate API health issues"),
        (ms > 1000, "Optimize API response times (currently > 1s)"),
        ((ms > 500) & (ms <= 1000), "Consider optimizing API response times"),
        (F.col("n_errors") > 0, "Fix prediction endpoint errors"),
        (F.col("prediction_ms") > 2000, "Optimize model inference time"),
        (~F.col("batch_ok"), "Fix batch prediction endpoint"),
        (F.col("throughput") < 5, "Improve batch processing throughput"),
        (~F.col("metrics_available"), "Enable Prometheus metrics collection"),
        fallback="Performance is optimal, continue monitoring",
    )
    return df.withColumn("advice", texts)


def drift_psi(base: DataFrame, current: DataFrame, keys: Sequence[str], value: str, floor: float = 1e-6) -> DataFrame:
    """Population stability index over the deciles of the base, with an alert flag."""
    edges = settle(quantiles(base, keys, {f"_e{i}": (value, i / 10) for i in range(1, 10)}), "deciles")
    both = base.select(*keys, value, F.lit(1).alias("_base")).unionByName(
        current.select(*keys, value, F.lit(0).alias("_base"))
    )
    slot = sum((F.when(F.col(value) > F.col(f"_e{i}"), 1).otherwise(0) for i in range(1, 10)), F.lit(0))
    is_base = F.col("_base") == 1
    cells = [F.count_if((F.col("_slot") == i) & side).alias(f"_{name}{i}") for i in range(10) for name, side in (("b", is_base), ("c", ~is_base))]
    rows = attach(both.where(F.col(value).isNotNull()), edges, keys).withColumn("_slot", slot)
    counted = rows.groupBy(*keys).agg(F.count_if(is_base).alias("_b"), F.count_if(~is_base).alias("_c"), *cells)

    def share(name: str, i: int) -> Column:
        return F.greatest(ratio(f"_{name}{i}", f"_{name}"), F.lit(floor))

    psi = sum(((share("c", i) - share("b", i)) * F.ln(F.try_divide(share("c", i), share("b", i))) for i in range(10)), F.lit(0.0))
    return counted.select(*keys, psi.alias("psi")).withColumn("drifted", F.col("psi") > DRIFT_LIMIT)


def drift_ks(base: DataFrame, current: DataFrame, s: Series, value: str) -> DataFrame:
    """Largest gap between the two distribution functions, per series.

    Equal values are counted together before anything is ordered; running totals over blocks then
    give both functions.
    """
    tagged = base.select(*s.keys, value, F.lit(1).alias("_b"), F.lit(0).alias("_c")).unionByName(
        current.select(*s.keys, value, F.lit(0).alias("_b"), F.lit(1).alias("_c"))
    )
    distinct = tagged.where(F.col(value).isNotNull()).groupBy(*s.keys, value).agg(F.sum("_b").alias("_b"), F.sum("_c").alias("_c"))
    points = settle(distinct, "points")
    totals = points.groupBy(*s.keys).agg(F.sum("_b").alias("_nb"), F.sum("_c").alias("_nc"))
    upto = running(points, Series(s.keys, value, (), s.block_rows), {"_fb": ("sum", "_b"), "_fc": ("sum", "_c")})
    gap = F.abs(ratio("_fb", "_nb") - ratio("_fc", "_nc"))
    return attach(upto, settle(totals, "totals"), s.keys).groupBy(*s.keys).agg(F.max(gap).alias("ks"))


def degradation(df: DataFrame, keys: Sequence[str], ts: str, since, unit: str = "month", slack: float = 1.2) -> DataFrame:
    """MAPE and accuracy (1 - MAPE / 100) per period from ``since`` on, against the MAPE before it.

    ``degraded`` marks periods whose MAPE exceeds ``slack`` times the earlier one; ``alert`` an
    accuracy below the limit.
    """
    mape = F.avg(F.abs(F.try_divide(F.col("y_true") - F.col("y_pred"), F.col("y_true")))) * 100
    before = settle(df.where(F.col(ts) < since).groupBy(*keys).agg(mape.alias("base_mape")), "base")
    periods = df.where(F.col(ts) >= since).groupBy(*keys, F.to_date(F.date_trunc(unit, F.col(ts))).alias("period")).agg(mape.alias("mape"))
    out = attach(periods, before, keys).withColumn("accuracy", 1 - F.col("mape") * 0.01)
    return out.withColumns({"degraded": F.col("mape") > F.col("base_mape") * slack, "alert": F.col("accuracy") < ACCURACY_LIMIT})
