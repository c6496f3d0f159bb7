"""Residual diagnostics, labels and the evaluation report."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import ladder, normal_quantile, notes, ratio
from tickloom.operators.blocks import Feature, Series, add_features, attach, numbered
from tickloom.operators.cleaning import flag_outliers
from tickloom.operators.metrics import P, Y, metrics
from tickloom.operators.quantiles import quantiles
from tickloom.sources.session import settle

# Bounds of the labels.
CLASSES = ("Excellent", "Very Good", "Good", "Fair", "Poor")
MAPE_BOUNDS = [(1.0, "Excellent"), (3.0, "Very Good"), (5.0, "Good"), (10.0, "Fair")]
R2_BOUNDS = [(0.9, "Excellent"), (0.8, "Very Good"), (0.7, "Good"), (0.5, "Fair")]
DIRECTION_BOUNDS = [(70.0, "Excellent"), (60.0, "Good"), (50.0, "Fair")]
DW_LOW, DW_HIGH = 1.5, 2.5
CORRELATED = 0.3
Z_LIMIT = 3.0
# Texts of the labels and recommendations.
POSITIVE, NEGATIVE, NONE = (
    "Positive autocorrelation",
    "Negative autocorrelation",
    "No significant autocorrelation",
)
HETERO, HOMO = "Heteroscedasticity detected", "Homoscedasticity"
ADVICE = {
    "mape": "Consider feature engineering or increasing model complexity to reduce MAPE",
    "r2": "Model explains less than 80% of variance - consider adding more features or regularization",
    "direction": "Poor directional accuracy - consider using directional loss function",
    "normality": "Residuals are not normally distributed - consider data transformation",
    "hetero": "Heteroscedasticity detected - consider robust regression or data transformation",
    "autocorrelation": "Autocorrelation in residuals - consider AR/MA components or longer sequences",
    "outliers": "High percentage of outliers - consider outlier removal or robust loss functions",
    "fine": "Model performance is satisfactory - consider ensemble methods for further improvement",
}

E = "error"


def with_errors(df: DataFrame) -> DataFrame:
    return df.withColumn(E, F.col(Y) - F.col(P))


def _step(df: DataFrame, s: Series) -> DataFrame:
    return df.withColumn("_de", F.col(E) - F.lag(E).over(s.window()))


def residual_stats(df: DataFrame, s: Series) -> DataFrame:
    """Moments, quartiles, Durbin-Watson and spread correlations of the errors per series."""
    rows = with_errors(df.select(*s.keys, s.ts, *s.tie, Y, P))
    stepped = add_features(rows, s, Feature(1, _step))
    e, p = F.col(E), F.col(P)
    base = stepped.groupBy(*s.keys).agg(
        F.count(e).alias("n"),
        F.avg(e).alias("mean"),
        F.stddev_pop(e).alias("std"),
        F.min(e).alias("min"),
        F.max(e).alias("max"),
        F.skewness(e).alias("skewness"),
        F.kurtosis(e).alias("kurtosis"),
        ratio(F.sum(F.col("_de") * F.col("_de")), F.sum(e * e)).alias("durbin_watson"),
        F.corr(p, e * e).alias("bp_correlation"),
        F.corr(p * p, e * e).alias("white_correlation"),
    )
    quarters = quantiles(rows, s.keys, {"q25": (E, 0.25), "q50": (E, 0.5), "q75": (E, 0.75)})
    return attach(base, quarters, s.keys)


def durbin_watson_label(c: Column) -> Column:
    return F.when(c < DW_LOW, POSITIVE).when(c > DW_HIGH, NEGATIVE).when(c.isNotNull(), NONE)


def spread_label(c: Column) -> Column:
    return F.when(F.abs(c) > CORRELATED, HETERO).when(c.isNotNull(), HOMO)


def standardised(df: DataFrame, s: Series) -> DataFrame:
    """Errors divided by their population deviation."""
    rows = with_errors(df)
    stats = settle(rows.groupBy(*s.keys).agg(F.stddev_pop(E).alias("_std")), "deviation")
    return attach(rows, stats, s.keys).withColumn("standardised", ratio(E, "_std")).drop("_std")


def jarque_bera(n: Column, skew: Column, kurt: Column) -> tuple[Column, Column]:
    stat = n * (1.0 / 6.0) * (skew * skew + kurt * kurt * 0.25)
    return stat, F.exp(stat * -0.5)


def dagostino(n: Column, skew: Column, kurt: Column) -> tuple[Column, Column]:
    """D'Agostino and Pearson's K2 from n, skewness and excess kurtosis; null below 8 rows."""
    d = F.try_divide
    one = F.lit(1.0)
    y = skew * F.sqrt(d((n + 1) * (n + 3), (n - 2) * 6.0))
    beta = d((n * n + n * 27 - 70) * 3.0 * (n + 1) * (n + 3), (n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt((beta - 1) * 2) - 1
    z_skew = F.asinh(y / F.sqrt(d(F.lit(2.0), w2 - 1))) * d(one, F.sqrt(F.ln(w2) * 0.5))

    expected = d((n - 1) * 3.0, n + 1)
    variance = d(n * 24.0 * (n - 2) * (n - 3), (n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = d(kurt + 3 - expected, F.sqrt(variance))
    root_beta = d((n * n - n * 5 + 2) * 6.0, (n + 7) * (n + 9)) * F.sqrt(
        d((n + 3) * 6.0 * (n + 5), n * (n - 2) * (n - 3))
    )
    a = d(F.lit(8.0), root_beta) * (d(F.lit(2.0), root_beta) + F.sqrt(d(F.lit(4.0), root_beta * root_beta) + 1)) + 6
    two_ninths = d(F.lit(2.0), a * 9)
    below = x * F.sqrt(d(F.lit(2.0), a - 4)) + 1
    z_kurt = d(
        1 - two_ninths - F.signum(below) * F.cbrt(d(1 - d(F.lit(2.0), a), F.abs(below))), F.sqrt(two_ninths)
    )
    stat = F.when(n >= 8, z_skew * z_skew + z_kurt * z_kurt)
    return stat, F.exp(stat * -0.5)


def normality(stats: DataFrame) -> DataFrame:
    """Add Jarque-Bera and D'Agostino statistics to a table with n, skewness, kurtosis."""
    n, g, k = F.col("n").cast("double"), F.col("skewness"), F.col("kurtosis")
    jb, jb_p = jarque_bera(n, g, k)
    k2, k2_p = dagostino(n, g, k)
    return stats.withColumns({"jarque_bera": jb, "jarque_bera_p": jb_p, "dagostino": k2, "dagostino_p": k2_p})


# Royston's published polynomials (constant term last): weights; mean and spread from 12 rows on, in the log of their number,
# and for 4 to 11 rows, in their number, after a shift that is linear in it.
_LAST = (-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0)
_NEXT = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0)
_MEAN = (0.0038915, -0.083751, -0.31082, -1.5861)
_SPREAD = (0.0030302, -0.082676, -0.4803)
_SMALL_SHIFT = (0.459, -2.273)
_SMALL_MEAN = (-6.714e-4, 0.025054, -0.39978, 0.5440)
_SMALL_SPREAD = (-0.0020322, 0.062767, -0.77857, 1.3822)


def _polynomial(terms, x: Column) -> Column:
    out = F.lit(terms[0])
    for t in terms[1:]:
        out = out * x + t
    return out


def _upper_tail(z: Column) -> Column:
    """Share of a standard normal above z (Zelen and Severo's approximation, error below 7.5e-8)."""
    t = F.try_divide(F.lit(1.0), F.abs(z) * 0.2316419 + 1)
    series = _polynomial((1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530, 0.0), t)
    upper = F.exp(z * z * -0.5) * 0.3989422804014327 * series
    return F.when(z >= 0, upper).otherwise(1 - upper)


def shapiro_wilk(df: DataFrame, s: Series) -> DataFrame:
    """Shapiro-Wilk W and p per series, from ordered errors.

    The weights need only row positions and a few sums, so one aggregation over the ordered rows
    gives W. Three rows have exact weights and an exact p, up to five one corrected weight, more two; up to eleven have
    their own approximation of p. Fewer than three rows, or equal errors only, give null.
    """
    rows = with_errors(df).select(*s.keys, s.ts, *s.tie, E).where(F.col(E).isNotNull())
    ordered = numbered(rows, Series(s.keys, E, (s.ts, *s.tie), s.block_rows))
    i, n, x = F.col("pos") + 1, F.col("n"), F.col(E)
    m = normal_quantile(F.try_divide(i - 0.375, n + 0.25))
    marked = ordered.withColumn("_m", m)

    def at(position: Column, c: str) -> Column:
        return F.max(F.when(i == position, F.col(c)))

    middle = (i > 2) & (i < n - 1)
    sums = marked.groupBy(*s.keys).agg(
        F.max("n").alias("n"),
        F.sum(F.col("_m") * F.col("_m")).alias("mm"),
        F.sum(F.when(middle, F.col("_m") * x)).alias("mx"),
        at(n, "_m").alias("m1"),
        at(n - 1, "_m").alias("m2"),
        (at(n, E) - at(F.lit(1), E)).alias("r1"),
        (at(n - 1, E) - at(F.lit(2), E)).alias("r2"),
        (F.var_pop(E) * F.count(E)).alias("ss"),
    )
    u = F.try_divide(F.lit(1.0), F.sqrt(F.col("n")))
    root = F.sqrt("mm")
    a1 = _polynomial(_LAST, u) + ratio("m1", root)
    a2 = _polynomial(_NEXT, u) + ratio("m2", root)
    m1, m2 = F.col("m1"), F.col("m2")
    phi = F.try_divide(F.col("mm") - m1 * m1 * 2 - m2 * m2 * 2, 1 - a1 * a1 * 2 - a2 * a2 * 2)
    large = a1 * F.col("r1") + a2 * F.col("r2") + ratio("mx", F.sqrt(phi))
    # with four or five rows only the ends are corrected
    one = F.try_divide(F.col("mm") - m1 * m1 * 2, 1 - a1 * a1 * 2)
    small = a1 * F.col("r1") + ratio(F.coalesce("mx", F.lit(0.0)) + m2 * F.col("r2"), F.sqrt(one))
    n = F.col("n")
    top = F.when(n == 3, F.col("r1") * math.sqrt(0.5)).when(n.between(4, 5), small).when(n > 5, large)
    share = F.try_divide(top * top, F.when(F.col("ss") > 0, F.col("ss")))
    w = F.when(share > 1, 1.0).otherwise(share)
    out = sums.select(*s.keys, "n", w.alias("w"))
    short = F.ln(1 - F.col("w"))
    log_n = F.ln("n")
    z = F.try_divide(short - _polynomial(_MEAN, log_n), F.exp(_polynomial(_SPREAD, log_n)))
    shift = _polynomial(_SMALL_SHIFT, n)
    few = F.try_divide(-F.ln(shift - short) - _polynomial(_SMALL_MEAN, n), F.exp(_polynomial(_SMALL_SPREAD, n)))
    exact = F.greatest(F.lit(0.0), (F.asin(F.sqrt("w")) - math.asin(math.sqrt(0.75))) * 6 / math.pi)
    p = (
        F.when(n == 3, exact)
        .when(F.col("w") >= 1, 1.0)
        .when((n <= 11) & (short >= shift), 0.0)
        .when(n <= 11, _upper_tail(few))
        .otherwise(_upper_tail(z))
    )
    return out.withColumn("p_value", F.when(F.col("w").isNotNull(), p))


def residual_outliers(df: DataFrame, s: Series) -> DataFrame:
    """Rows whose error is an outlier: |e / std| > 3 (``z_outlier``) or outside the quartile range."""
    rows = standardised(df, s)
    flagged = flag_outliers(rows, s.keys, [E], "iqr").withColumnRenamed(f"{E}_outlier", "iqr_outlier")
    z = F.coalesce(F.abs("standardised") > Z_LIMIT, F.lit(False))
    return flagged.withColumn("z_outlier", z)


def residual_outlier_summary(df: DataFrame, s: Series) -> DataFrame:
    n = F.count(F.lit(1))
    z, q = F.count_if("z_outlier"), F.count_if("iqr_outlier")
    return residual_outliers(df, s).groupBy(*s.keys).agg(
        z.alias("z_count"), (ratio(z, n) * 100).alias("z_pct"), q.alias("iqr_count"), (ratio(q, n) * 100).alias("iqr_pct")
    )


def residual_series(df: DataFrame, s: Series) -> DataFrame:
    """Errors over time and against the forecast."""
    return with_errors(df).select(*s.keys, s.ts, P, E)


def classify(scores: DataFrame) -> DataFrame:
    """Label MAPE, R2 and direction; the overall label is the worst of the three."""

    def low(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(float("inf") if c == "mape" else float("-inf")))

    labels = {
        "mape_class": ladder(low("mape"), MAPE_BOUNDS, "Poor", above=False),
        "r2_class": ladder(low("r2"), R2_BOUNDS, "Poor"),
        "direction_class": ladder(low("direction_accuracy"), DIRECTION_BOUNDS, "Poor"),
    }
    order = F.array(*[F.lit(c) for c in CLASSES])
    out = scores.withColumns(labels)
    worst = F.greatest(*[F.array_position(order, F.col(c)) for c in labels])
    return out.withColumn("overall", F.element_at(order, worst.cast("int")))


def recommend(report: DataFrame) -> DataFrame:
    """Advice texts. Needs metrics, residual statistics, normality and the share of z outliers."""
    not_normal = F.least("jarque_bera_p", "dagostino_p") < 0.05
    correlated = durbin_watson_label(F.col("durbin_watson")) != NONE
    texts = notes(
        (F.col("mape") > 5, ADVICE["mape"]),
        (F.col("r2") < 0.8, ADVICE["r2"]),
        (F.col("direction_accuracy") < 60, ADVICE["direction"]),
        (not_normal, ADVICE["normality"]),
        (F.abs("bp_correlation") > CORRELATED, ADVICE["hetero"]),
        (correlated, ADVICE["autocorrelation"]),
        (F.col("z_pct") > 5, ADVICE["outliers"]),
        fallback=ADVICE["fine"],
    )
    return report.withColumn("recommendations", texts)


def evaluation_report(df: DataFrame, s: Series) -> DataFrame:
    """One row per series: metrics, residual statistics, labels and advice.

    About eight passes read the forecasts, so they are written once, with the needed columns only.
    """
    df = settle(df.select(*s.keys, s.ts, *s.tie, Y, P), "forecasts")
    stats = normality(residual_stats(df, s)).drop("n", "mean", "std", "min", "max")
    outliers = residual_outlier_summary(df, s)
    scores = classify(metrics(df, s))
    joined = attach(attach(scores, stats, s.keys), outliers, s.keys)
    labelled = joined.withColumns(
        {"autocorrelation": durbin_watson_label(F.col("durbin_watson")), "spread": spread_label(F.col("bp_correlation"))}
    )
    return recommend(labelled)
