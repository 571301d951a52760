"""P-values of the two-sample tests."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SERIES_TERMS = 100
SERIES_FROM = 0.2  # below this z the alternating series has not settled and p is 1 to every digit shown


def kolmogorov_p(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic p-value of a two-sample Kolmogorov–Smirnov distance."""
    n, m = n.cast("double"), m.cast("double")
    z2 = d * d * n * m / F.nullif(n + m, F.lit(0.0))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(SERIES_TERMS)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(F.lit(-2.0) * k * k * z2),
    )
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * series))
    return F.when(z2 < SERIES_FROM * SERIES_FROM, F.lit(1.0)).otherwise(clamped)


def _upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x): power series below a + 1, continued fraction above."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * front)
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        c = b + an / c
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return min(1.0, front * h)


def chi_square_tail(statistic: float | None, df: float | None) -> float | None:
    if statistic is None or df is None or math.isnan(statistic) or math.isnan(df):
        return None
    return 1.0 if df <= 0 else _upper_gamma(df / 2.0, statistic / 2.0)


@F.pandas_udf(T.DoubleType())
def chi_square_p(statistic: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of chi-square. Runs on one row per feature and batch, never on data rows."""
    return pd.Series([chi_square_tail(s, d) for s, d in zip(statistic, df)], dtype="float64")
