"""Small column helpers shared by the operators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(col(a), col(b))


def pct_change_or_zero(old: str | Column, new: str | Column) -> Column:
    """Change from old to new in percent; 0 where old is 0."""
    old, new = col(old), col(new)
    return F.when(old == 0, F.lit(0.0)).otherwise(F.try_divide(new - old, old) * 100)


def no_nan(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating column."""
    fixed = {
        f.name: F.when(~F.isnan(f.name), F.col(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(fixed) if fixed else df


def ladder(value: Column, steps: list[tuple[float, str]], otherwise: str, above: bool = True) -> Column:
    """First label whose bound the value passes (``>`` when above, else ``<``)."""
    out = None
    for bound, label in steps:
        test = value > bound if above else value < bound
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def notes(*pairs: tuple[Column, str], fallback: str | None = None) -> Column:
    """Array of the texts whose condition holds; ``fallback`` alone when none does."""
    texts = F.array_compact(F.array(*[F.when(test, F.lit(text)) for test, text in pairs]))
    if fallback is None:
        return texts
    return F.when(F.size(texts) == 0, F.array(F.lit(fallback))).otherwise(texts)


# Coefficients of Acklam's published rational approximation of the
# inverse normal distribution function (relative error below 1.15e-9).
_CENTRE_NUM = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239)
_CENTRE_DEN = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
_TAIL_NUM = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_TAIL_DEN = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)


def _poly(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function, null outside (0, 1)."""
    q = p - 0.5
    centre = F.try_divide(_poly(_CENTRE_NUM, q * q) * q, _poly(_CENTRE_DEN, q * q))

    def tail(share: Column) -> Column:
        t = F.sqrt(F.lit(-2.0) * F.ln(share))
        return F.try_divide(_poly(_TAIL_NUM, t), _poly(_TAIL_DEN, t))

    return (
        F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
        .when(p < 0.02425, tail(p))
        .when(p > 1 - 0.02425, -tail(1 - p))
        .otherwise(centre)
    )


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Round the named columns (all floating ones by default)."""
    chosen = names or [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.round(c, digits) for c in chosen})
