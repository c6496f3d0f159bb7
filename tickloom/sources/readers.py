"""Quote tables from JSON, CSV or parquet, and the metric stream."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Field names of the raw quote files.
ID, SELL, BUY, UPDATED = "id", "hargaJual", "hargaBeli", "lastUpdate"

RAW_QUOTES = T.StructType([T.StructField(c, T.StringType()) for c in (ID, SELL, BUY, UPDATED)])
METRICS = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("job", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("client", T.LongType()),
    ]
)


def read_quotes(
    spark: SparkSession,
    path: str,
    fmt: str = "json",
    columns: Sequence[str] | None = None,
    lines: bool = False,
) -> DataFrame:
    """Raw quotes with every field as text; ``columns`` names another layout.

    ``lines`` reads JSON Lines, which Spark can split; an array file is one task per file.
    """
    schema = RAW_QUOTES if columns is None else T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.read.schema(schema)
    if fmt == "json":
        return reader.option("multiLine", not lines).option("primitivesAsString", True).json(path)
    if fmt == "csv":
        return reader.option("header", True).csv(path)
    if fmt == "parquet":
        return spark.read.parquet(path).select(*[F.col(f.name).cast("string") for f in schema])
    raise ValueError(f"unsupported format: {fmt}")


def as_timestamps(df: DataFrame) -> DataFrame:
    """Cast zoneless timestamps to TIMESTAMP, which watermarks need."""
    zoneless = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return as_timestamps(spark.read.parquet(f"{folder}/{name}.parquet"))


def read_metric_stream(
    spark: SparkSession, folder: str, schema: T.StructType = METRICS, files_per_trigger: int = 1
) -> DataFrame:
    """Stream of metric files; new files are picked up in the order they were written."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )
