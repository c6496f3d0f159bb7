"""Calendar fields of a date or timestamp column."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import col
from tickloom.operators.blocks import Series

# Periods of the cyclic encodings.
MONTH_PERIOD = 12
DAY_PERIOD = 31
WEEKDAY_PERIOD = 7


def _cycle(value: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2.0) * F.pi() * F.try_divide(value, F.lit(period))
    return F.sin(angle), F.cos(angle)


def calendar_columns(ts: str | Column, prefix: str = "time_") -> dict[str, Column]:
    """All calendar fields as a name -> column map (Monday is weekday 0)."""
    t = col(ts)
    month, day, weekday = F.month(t), F.dayofmonth(t), F.weekday(t)
    first, last = day == 1, F.to_date(t) == F.last_day(t)
    fields = {
        "year": F.year(t),
        "month": month,
        "day": day,
        "weekday": weekday,
        "quarter": F.quarter(t),
        "day_of_year": F.dayofyear(t),
        "week_of_year": F.weekofyear(t),
    }
    for name, value, period in (
        ("month", month, MONTH_PERIOD),
        ("day", day, DAY_PERIOD),
        ("weekday", weekday, WEEKDAY_PERIOD),
    ):
        fields[f"{name}_sin"], fields[f"{name}_cos"] = _cycle(value, period)
    fields.update(
        is_business_day=weekday < 5,
        is_weekend=weekday >= 5,
        is_month_start=first,
        is_month_end=last,
        is_quarter_start=first & (month % 3 == 1),
        is_quarter_end=last & (month % 3 == 0),
    )
    return {prefix + name: value for name, value in fields.items()}


def add_calendar(df: DataFrame, ts: str = "ts", prefix: str = "time_") -> DataFrame:
    return df.withColumns(calendar_columns(ts, prefix))


def add_names(df: DataFrame, ts: str = "ts") -> DataFrame:
    """English month and weekday names."""
    return df.withColumns({"month_name": F.date_format(ts, "MMMM"), "weekday_name": F.date_format(ts, "EEEE")})


def future_dates(df: DataFrame, s: Series, steps: int) -> DataFrame:
    """``steps`` daily timestamps after the last one of each series: (keys, step, ts)."""
    last = df.groupBy(*s.keys).agg(F.max(s.ts).alias("_last"))
    return last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps)))).select(
        *s.keys, "step", (F.col("_last") + F.make_dt_interval(F.col("step"))).cast(df.schema[s.ts].dataType).alias(s.ts)
    )


def span(df: DataFrame, s: Series) -> DataFrame:
    """First and last date and the days between them, per series."""
    return df.groupBy(*s.keys).agg(F.min(s.ts).alias("first"), F.max(s.ts).alias("last")).withColumn(
        "days", F.datediff("last", "first")
    )
