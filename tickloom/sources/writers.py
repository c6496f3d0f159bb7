"""Sinks: features, predictions, reports, run metrics."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_features(
    df: DataFrame, path: str, fmt: str = "csv", partition_by: Sequence[str] = (), mode: str = "overwrite"
) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported format: {fmt}")


def with_month(df: DataFrame, ts: str = "ts") -> DataFrame:
    """A ``month`` column to partition the sink by, so time filters prune folders."""
    return df.withColumn("month", F.date_format(ts, "yyyy-MM"))


def prediction_summary(df: DataFrame, value: str = "y_pred", keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.min(value).alias("lowest"), F.max(value).alias("highest")
    )


def write_predictions(df: DataFrame, path: str, value: str = "y_pred", keys: Sequence[str] = ()) -> None:
    """Detailed rows under ``detailed`` and the range per series under ``summary``, as JSON."""
    df.write.mode("overwrite").json(f"{path}/detailed")
    prediction_summary(df, value, keys).write.mode("overwrite").json(f"{path}/summary")


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def prediction_log(df: DataFrame, actual: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """Add ``error`` = actual - predicted."""
    return df.withColumn("error", F.col(actual) - F.col(predicted))


def align(actual: DataFrame, predicted: DataFrame, on: Sequence[str]) -> DataFrame:
    """Pair actual and predicted rows of the same series and time."""
    return actual.join(predicted, list(on), "inner")


def append_metrics(df: DataFrame, path: str, run: str = "run_id") -> None:
    """Append (run_id, step, metric, value) rows to the run log."""
    df.write.mode("append").partitionBy(run).parquet(path)
