"""Statistics of paired samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def p_less(t: float, df: float) -> float:
    """The one-sided p-value that the first sample's mean is lower."""
    half = incomplete_beta(df / 2, 0.5, df / (df + t * t)) / 2
    return half if t < 0 else 1 - half


def paired_t(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """(n, mean_diff, sd_diff, t): the paired t statistic of a - b over rows where both are known."""
    d = rows.select((a - b).cast("double").alias("d"))
    out = d.agg(F.count("d").alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd_diff"))
    return out.withColumn("t", F.col("mean_diff") / (F.col("sd_diff") / F.sqrt("n")))


def paired_test(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """``paired_t`` with p, one-sided: that a is lower.  One row; the p-value is computed from it by a Python function."""
    p = F.udf(lambda t, n: None if t is None or n < 2 else float(p_less(t, n - 1)), "double")
    return paired_t(rows, a, b).withColumn("p", p("t", "n"))
