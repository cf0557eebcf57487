"""Functions that Spark lacks."""

from __future__ import annotations

from math import exp, lgamma, log

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 500):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + n * d) or tiny)
            c = (1 + n / c) or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return f * exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a


def _p_value(r: float, n: int) -> float | None:
    if r is None or n is None or n < 3:
        return None
    return 0.0 if abs(r) >= 1 else incomplete_beta((n - 2) / 2, 0.5, 1 - r * r)


@F.pandas_udf(DoubleType())
def _student(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([_p_value(a, b) for a, b in zip(r, n, strict=True)], dtype="float64")


def student_p_value(r: Column, n: Column) -> Column:
    """Two-sided p-value of a Pearson correlation over n pairs."""
    return _student(r, n)
