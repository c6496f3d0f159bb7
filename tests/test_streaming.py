"""Streams over files: late rows, and agreement with the batch form."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import monitor
from tickloom.sources.readers import METRICS, read_metric_stream
from tickloom.sources.session import new_path
from tickloom.streaming import monitor as live

START = dt.datetime(2024, 1, 1)


def log(spark, minutes, latency=10.0):
    rows = [(START + dt.timedelta(minutes=m), "api", 500 if m % 4 == 0 else 200, latency, 1) for m in minutes]
    return spark.createDataFrame(rows, METRICS)


def test_late_rows_are_dropped_and_counted(spark):
    path = new_path(spark, "late")
    for minutes in (range(0, 30), range(60, 90), [2, 3]):
        log(spark, minutes).coalesce(1).write.mode("append").parquet(path)
    stream = live.windowed_requests(read_metric_stream(spark, path), slide_s=300)
    out = new_path(spark, "out")
    late = live.run_available(stream, out, new_path(spark, "progress"))
    assert late >= 1
    got = {r.start: r.n for r in spark.read.parquet(out).collect()}
    batch = monitor.tumbling_rate(log(spark, [*range(0, 30), *range(60, 90)]), ["job"])
    closed = batch.where(F.col("end") <= F.lit(START + dt.timedelta(minutes=79)))
    assert got == {r.start: r.n for r in closed.collect()}


def test_late_rows_of_all_batches_are_counted(spark):
    path = new_path(spark, "late")
    for minute in range(0, 400, 20):
        log(spark, [minute, *([minute - 60, minute - 90] if minute >= 100 else [])]).coalesce(1).write.mode("append").parquet(path)
    before = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    try:
        stream = live.windowed_requests(read_metric_stream(spark, path), slide_s=300)
        assert live.run_available(stream, new_path(spark, "out"), new_path(spark, "progress")) == 2 * 15
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", before)


def gone(samples, limit, watermark):
    """Outages of each series by walking its sorted samples."""
    out = set()
    for name in {n for n, _ in samples}:
        times = sorted(t for n, t in samples if n == name)
        for t, after in zip(times, [*times[1:], None], strict=True):
            if (after is None or after - t > limit) and t + limit < watermark:
                out.add((name, t, t + limit))
    return out


@pytest.mark.parametrize("files, jitter_s", [(1, 0), (5, 0), (60, 500), (1, 10**7)])
def test_absences_do_not_depend_on_files_or_order(spark, files, jitter_s):
    rng = random.Random(files + jitter_s)
    limit = dt.timedelta(seconds=300)
    samples = []
    for name in ("a", "b", None, "gone"):
        at = START
        while at < START + dt.timedelta(hours=30 if name == "gone" else 40):
            samples.append((name, at))
            at += dt.timedelta(seconds=rng.choice((20, 60, 299, 300, 300.000001, 301, 900, 4000)))
    order = sorted(samples, key=lambda r: (r[1] + dt.timedelta(seconds=rng.uniform(0, jitter_s)), str(r[0])))
    path = new_path(spark, "absences")
    size = -(-len(order) // files)
    for i in range(0, len(order), size):
        spark.createDataFrame(order[i : i + size], "series string, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    stream = live.missing_series(read_metric_stream(spark, path, "series string, ts timestamp"), 300)
    out = new_path(spark, "out")
    assert live.run_available(stream, out, new_path(spark, "progress")) == 0
    got = [tuple(r) for r in spark.read.schema("series string, gone_from timestamp, detected_at timestamp").parquet(out).collect()]
    end = max(t for _, t in samples).replace(microsecond=0) - dt.timedelta(minutes=10)
    assert len(got) == len(set(got)) and any(t > START + dt.timedelta(hours=29) for n, t, _ in got if n == "gone")
    late = {r for r in set(got) ^ gone(samples, limit, end) if r[2] < end - dt.timedelta(seconds=1)}
    assert not late
