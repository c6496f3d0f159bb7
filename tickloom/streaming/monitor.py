"""Streaming forms of the request windows, alert holds and absences."""
from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.functions.columns import ratio
from tickloom.operators.monitor import ERROR_RATIO, SLIDE_S, VOLUME_HIGH, VOLUME_LOW, WINDOW_S, is_error

WATERMARK = "10 minutes"
#: Seconds between looks at a running query's reports.
POLL_S = 0.2

# the processors below travel to the workers whole, so workers need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def windowed_requests(stream: DataFrame, keys=("job",), window_s: int = WINDOW_S, slide_s: int = SLIDE_S) -> DataFrame:
    """Rate, latency and error share per event-time window, emitted once the watermark has passed."""
    n, bad = F.count(F.lit(1)), F.count_if(is_error(F.col("status")))
    grouped = (
        stream.withWatermark("ts", WATERMARK)
        .groupBy(F.window("ts", f"{window_s} seconds", f"{slide_s} seconds").alias("w"), *keys)
        .agg(
            n.alias("n"),
            ratio(n, F.lit(window_s)).alias("rate"),
            F.avg("latency_ms").alias("avg_ms"),
            F.max("latency_ms").alias("max_ms"),
            F.percentile_approx("latency_ms", 0.95, 10_000).alias("p95_ms"),
            ratio(bad, n).alias("error_ratio"),
        )
    )
    return grouped.select(
        *keys,
        F.col("w.start").alias("start"),
        F.col("w.end").alias("end"),
        "n",
        "rate",
        "avg_ms",
        "max_ms",
        "p95_ms",
        "error_ratio",
        (F.col("error_ratio") > ERROR_RATIO).alias("high_errors"),
        ((F.col("rate") > VOLUME_HIGH) | (F.col("rate") < VOLUME_LOW)).alias("unusual"),
    )


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> int:
    """Process all files present, write the results to ``path``; returns the rows dropped as late."""
    started = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    # a query keeps the reports of its last batches only, so they are read while it runs
    late: dict[int, int] = {}
    ended = False
    while not ended:
        ended = started.awaitTermination(POLL_S)
        for progress in started.recentProgress:
            late[progress["batchId"]] = sum(op.get("numRowsDroppedByWatermark", 0) for op in progress["stateOperators"])
    return sum(late.values())


HELD = "alert string, series string, ts timestamp, since timestamp, firing boolean"


class HoldProcessor(StatefulProcessor):
    """Per (alert, series): when the current breach began. One sample in, one row out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.began = handle.getValueState("began", "us bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        alert, series = key
        batch = pd.concat(list(rows)).sort_values("ts", kind="stable")
        held = self.began.get()
        began = None if held is None or held[0] < 0 else held[0]
        since, firing = [], []
        for ts, breached, hold_s in zip(batch["ts"], batch["breached"], batch["hold_s"], strict=True):
            us = ts.value // 1000
            began = (us if began is None else began) if breached else None
            since.append(None if began is None else pd.Timestamp(began, unit="us"))
            firing.append(began is not None and us - began >= hold_s * 1_000_000)
        self.began.update((-1 if began is None else began,))
        yield pd.DataFrame(
            {"alert": alert, "series": series, "ts": batch["ts"].to_numpy(), "since": pd.to_datetime(pd.Series(since)).to_numpy(), "firing": firing}
        )

    def close(self) -> None:
        pass


def held_alerts(stream: DataFrame) -> DataFrame:
    """Hold evaluation over a stream of (alert, series, ts, breached, hold_s) samples.

    A group is one series of one rule, so it gets a sample per scrape. Needs the RocksDB state store.
    """
    return (
        stream.withWatermark("ts", WATERMARK)
        .groupBy("alert", "series")
        .transformWithStateInPandas(HoldProcessor(), outputStructType=HELD, outputMode="Append", timeMode="EventTime")
    )


def missing_series(stream: DataFrame, limit_s: int = 60) -> DataFrame:
    """A row for each time a series went without a sample for more than ``limit_s`` seconds: (series, gone_from, detected_at).

    Samples within the limit of each other form a session, whatever order or files they come in; the series is gone from the last
    of them. The row comes once the watermark has passed the limit, also for a series that never comes back. A null series is a series.
    """
    # sessions that touch are joined, so samples exactly the limit apart belong together
    gap = F.session_window("ts", f"{limit_s} seconds")
    last = F.max("ts")
    found = stream.withWatermark("ts", WATERMARK).groupBy(gap.alias("w"), "series").agg(last.alias("gone_from"))
    return found.select("series", "gone_from", (F.col("gone_from") + F.make_dt_interval(secs=F.lit(limit_s))).alias("detected_at"))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"
