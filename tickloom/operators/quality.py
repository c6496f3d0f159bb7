"""Validation checks and data-quality reports. Each is one aggregation over the table."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.columns import ratio

# Limits of a forecast request and of a batch.
MIN_HISTORY = 50
DEFAULT_STEPS, DEFAULT_CONFIDENCE = 1, 0.95
MIN_STEPS, MAX_STEPS = 1, 30
MIN_CONFIDENCE, MAX_CONFIDENCE = 0.5, 0.99
MIN_BATCH, MAX_BATCH = 1, 10

CHECKS = "check STRING, ok BOOLEAN, n_bad BIGINT, detail STRING, level STRING"


def as_number(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def as_time(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).try_cast("timestamp")


def _count_if(test: Column) -> Column:
    return F.count(F.when(test, F.lit(1)))


def _counts_to_rows(row: DataFrame, names: dict[str, str], label: str, value: str) -> DataFrame:
    """One row of counts to (label, value) rows."""
    pairs = F.array(*[
        F.struct(F.lit(shown).alias(label), F.col(c).cast("bigint").alias(value)) for c, shown in names.items()
    ])
    return row.select(F.inline(pairs))


def _duplicates(ts: Column, keys: Sequence[str]) -> Column:
    # struct of keys and time; null times do not count
    held = F.when(ts.isNotNull(), F.struct(*keys, ts.alias("t")))
    return F.count(ts) - F.count_distinct(held)


def validate(
    df: DataFrame, required: Sequence[str], date_col: str, keys: Sequence[str] = (), strict: bool = False
) -> DataFrame:
    """Checks as rows (check, ok, n_bad, detail, level).

    Repeated dates are a warning, since cleaning removes them; ``strict`` makes them an error.
    """
    wanted = list(dict.fromkeys([*required, date_col]))
    missing = [c for c in wanted if c not in df.columns]
    numeric = [c for c in required if c != date_col and c in df.columns]
    aggs = [F.count(F.lit(1)).alias("rows")]
    if date_col in df.columns:
        t = as_time(date_col)
        aggs += [
            _count_if(F.col(date_col).isNotNull() & t.isNull()).alias("bad_dates"),
            _duplicates(t, keys).alias("duplicates"),
        ]
    aggs += [_count_if(F.col(c).isNotNull() & as_number(c).isNull()).alias(f"bad_{c}") for c in numeric]
    counted = df.agg(*aggs)

    def check(name: str, n_bad: Column, detail: str, level: str = "error") -> Column:
        n_bad = n_bad.cast("bigint")
        return F.struct(
            F.lit(name).alias("check"),
            (n_bad == 0).alias("ok"),
            n_bad.alias("n_bad"),
            F.lit(detail).alias("detail"),
            F.lit(level).alias("level"),
        )

    rows = [check("required_columns", F.lit(len(missing)), ",".join(missing))]
    if date_col in df.columns:
        rows.append(check("date_format", F.col("bad_dates"), date_col))
    rows.append(check("not_empty", F.when(F.col("rows") == 0, 1).otherwise(0), ""))
    if date_col in df.columns:
        rows.append(check("unique_dates", F.col("duplicates"), date_col, "error" if strict else "warning"))
    rows += [check(f"numeric_{c}", F.col(f"bad_{c}"), c) for c in numeric]
    return counted.select(F.inline(F.array(*rows)))


def require_valid(
    df: DataFrame, required: Sequence[str], date_col: str, keys: Sequence[str] = (), strict: bool = False
) -> DataFrame:
    """Return ``df`` unchanged, or raise with the failed checks."""
    failed = validate(df, required, date_col, keys, strict).where("not ok and level = 'error'").collect()
    if failed:
        raise ValueError("invalid data: " + "; ".join(f"{r['check']} ({r.n_bad}) {r.detail}".strip() for r in failed))
    return df


def missing_counts(df: DataFrame) -> DataFrame:
    """Null count per column: (column, n_missing)."""
    row = df.agg(*[_count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return _counts_to_rows(row, {c: c for c in df.columns}, "column", "n_missing")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row in every column: (n_duplicates)."""
    return (
        df.groupBy(*df.columns)
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("n_duplicates"))
    )


def negative_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = df.agg(*[_count_if(as_number(c) < 0).alias(c) for c in columns])
    return _counts_to_rows(row, {c: c for c in columns}, "column", "n_negative")


def validate_requests(
    df: DataFrame,
    request: str = "request_id",
    date_col: str = "date",
    price: str = "price",
    steps: str = "steps",
    confidence: str = "confidence",
) -> DataFrame:
    """Accept or reject forecast requests given as rows of history: one row per request.

    A request without steps or confidence gets the defaults.
    """
    facts = df.groupBy(request).agg(
        F.count(F.lit(1)).alias("n_rows"),
        _count_if(F.col(date_col).isNull() | F.col(price).isNull()).alias("n_incomplete"),
        F.coalesce(F.max(steps), F.lit(DEFAULT_STEPS)).alias("steps"),
        F.coalesce(F.max(confidence), F.lit(DEFAULT_CONFIDENCE)).alias("confidence"),
    )
    reason = (
        F.when(F.col("n_rows") < MIN_HISTORY, "too few rows")
        .when(F.col("n_incomplete") > 0, "incomplete rows")
        .when(~F.col("steps").between(MIN_STEPS, MAX_STEPS), "steps out of range")
        .when(~F.col("confidence").between(MIN_CONFIDENCE, MAX_CONFIDENCE), "confidence out of range")
    )
    return facts.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def validate_batches(df: DataFrame, batch: str = "batch_id", request: str = "request_id") -> DataFrame:
    """A batch holds 1 to 10 requests."""
    return (
        df.groupBy(batch)
        .agg(F.count_distinct(request).alias("n_requests"))
        .withColumn("accepted", F.col("n_requests").between(MIN_BATCH, MAX_BATCH))
    )


def cleaning_report(
    raw: DataFrame, cleaned: DataFrame, columns: Sequence[str], keys: Sequence[str], ts: str, outliers: DataFrame
) -> DataFrame:
    """Rows, nulls, removed duplicates and outliers as (stage, metric, value) rows.

    ``raw`` has parsed types; ``outliers`` carries the ``{column}_outlier`` flags.
    """

    def shape(df: DataFrame, stage: str) -> DataFrame:
        row = df.agg(
            F.count(F.lit(1)).alias("rows"),
            *[_count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns],
        )
        return _counts_to_rows(row, {c: c for c in row.columns}, "metric", "value").withColumn("stage", F.lit(stage))

    removed = raw.agg(_duplicates(F.col(ts), keys).alias("duplicates_removed"))
    flagged = outliers.agg(*[_count_if(F.col(f"{c}_outlier")).alias(f"outliers_{c}") for c in columns])
    parts = [shape(raw, "initial"), shape(cleaned, "final")]
    parts += [
        _counts_to_rows(row, {c: c for c in row.columns}, "metric", "value").withColumn("stage", F.lit("cleaning"))
        for row in (removed, flagged)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("stage", "metric", "value")


def profile(df: DataFrame, ts: str) -> DataFrame:
    """One row per column: type, values present, table size and date range."""
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(ts).cast("string").alias("first"),
        F.max(ts).cast("string").alias("last"),
        *[F.count(c).alias(f"_n{i}") for i, c in enumerate(df.columns)],
    )
    columns = F.array(*[
        F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"_n{i}").alias("present"))
        for i, f in enumerate(df.schema.fields)
    ])
    return counted.select("rows", F.lit(len(df.columns)).cast("bigint").alias("columns"), "first", "last", F.inline(columns))


def quality_score(
    df: DataFrame, prices: Sequence[str], date_col: str, keys: Sequence[str] = (), threshold: float = 0.8
) -> DataFrame:
    """Mean pass rate of dates, unique dates, presence, numbers and sign, with an alert flag."""
    n = F.count(F.lit(1))
    t = as_time(date_col)
    cells = n * len(prices)

    def price_rate(bad) -> Column:
        total = sum((_count_if(bad(c)) for c in prices), F.lit(0))
        return 1 - ratio(total, cells)

    rates = {
        "date_rate": 1 - ratio(_count_if(t.isNull()), n),
        "unique_rate": 1 - ratio(_duplicates(t, keys), n),
        "present_rate": price_rate(lambda c: F.col(c).isNull()),
        "numeric_rate": price_rate(lambda c: F.col(c).isNotNull() & as_number(c).isNull()),
        "sign_rate": price_rate(lambda c: as_number(c) < 0),
    }
    out = df.agg(*[rate.alias(name) for name, rate in rates.items()])
    score = F.try_divide(sum((F.col(name) for name in rates), F.lit(0.0)), F.lit(len(rates)))
    return out.withColumn("score", score).withColumn("alert", F.col("score") < threshold)
