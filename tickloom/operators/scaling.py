"""Fitted scalers kept as a small parameter table."""
from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.blocks import attach
from tickloom.operators.quantiles import quantiles
from tickloom.sources.session import settle

_NUMBERS = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType)


def scalable_columns(df: DataFrame, ts: str = "ts", skip: Sequence[str] = ("id",)) -> list[str]:
    """Number columns, without the date, the id, and calendar fields that are not cyclic."""
    names = []
    for f in df.schema.fields:
        plain_calendar = f.name.startswith("time_") and not f.name.endswith(("_sin", "_cos"))
        if isinstance(f.dataType, _NUMBERS) and f.name != ts and f.name not in skip and not plain_calendar:
            names.append(f.name)
    return names


@dataclass(frozen=True)
class Scaler:
    """x -> (x - shift) / spread * gain + base, with one (shift, spread) pair per key and column.

    ``params`` has the key columns and ``_shift_{c}``, ``_spread_{c}`` per column. A spread of 0
    counts as 1, so a constant column maps to the base.
    """

    kind: str
    keys: tuple[str, ...]
    columns: tuple[str, ...]
    low: float
    high: float
    params: DataFrame

    def _terms(self, c: str) -> tuple[Column, Column]:
        spread = F.col(f"_spread_{c}")
        return F.col(f"_shift_{c}"), F.when(spread == 0, F.lit(1.0)).otherwise(spread)

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c in self.columns:
            shift, spread = self._terms(c)
            scaled = F.try_divide(F.col(c) - shift, spread)
            out[c] = scaled * (self.high - self.low) + self.low if self.kind == "minmax" else scaled
        return attach(df, self.params, self.keys).withColumns(out).select(*df.columns)

    def inverse(self, df: DataFrame, column: str, target: str) -> DataFrame:
        """Bring ``column`` back to the scale of the fitted column ``target``."""
        if target not in self.columns:
            raise ValueError(f"{target} was not fitted")
        shift, spread = self._terms(target)
        x = F.col(column)
        if self.kind == "minmax":
            x = F.try_divide(x - self.low, F.lit(self.high - self.low))
        return attach(df, self.params, self.keys).withColumn(column, x * spread + shift).select(*df.columns)

    def save(self, path: str) -> None:
        """Parameters as parquet, settings as one JSON row."""
        self.params.write.mode("overwrite").parquet(f"{path}/params")
        facts = {"kind": self.kind, "keys": self.keys, "columns": self.columns, "low": self.low, "high": self.high}
        spark = self.params.sparkSession
        spark.createDataFrame([(json.dumps(facts),)], "value string").write.mode("overwrite").text(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Scaler":
        facts = json.loads(spark.read.text(f"{path}/settings").first()[0])
        params = spark.read.parquet(f"{path}/params")
        return cls(facts["kind"], tuple(facts["keys"]), tuple(facts["columns"]), facts["low"], facts["high"], params)


def fit_scaler(
    df: DataFrame,
    columns: Sequence[str],
    kind: str = "minmax",
    keys: Sequence[str] = (),
    low: float = 0.0,
    high: float = 1.0,
) -> Scaler:
    """``minmax`` to [low, high], ``standard`` (population deviation) or ``robust`` (median, quartile range)."""
    if kind == "minmax":
        params = df.groupBy(*keys).agg(
            *[a for c in columns for a in (F.min(c).alias(f"_shift_{c}"), (F.max(c) - F.min(c)).alias(f"_spread_{c}"))]
        )
    elif kind == "standard":
        params = df.groupBy(*keys).agg(
            *[a for c in columns for a in (F.avg(c).alias(f"_shift_{c}"), F.stddev_pop(c).alias(f"_spread_{c}"))]
        )
    elif kind == "robust":
        wanted = {f"_{name}_{c}": (c, p) for c in columns for name, p in (("q1", 0.25), ("shift", 0.5), ("q3", 0.75))}
        params = quantiles(df, keys, wanted).withColumns(
            {f"_spread_{c}": F.col(f"_q3_{c}") - F.col(f"_q1_{c}") for c in columns}
        )
        params = params.drop(*[f"_{q}_{c}" for c in columns for q in ("q1", "q3")])
    else:
        raise ValueError(f"unknown scaler: {kind}")
    return Scaler(kind, tuple(keys), tuple(columns), low, high, settle(params, "scaler"))
