"""Two-sided p-values of Student's t, for the few result rows of a model."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        change = 1.0
        for step in (even, odd):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            change = c * d
            total *= change
        if abs(change - 1) < 1e-15:
            break
    return front * total / a


def two_sided_p(t: float, df: float) -> float:
    if not (df > 0) or math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 0.0
    return _beta_tail(df / 2, 0.5, df / (df + t * t))


@F.pandas_udf(T.DoubleType())
def t_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    pairs = zip(t.to_numpy(dtype=float), df.to_numpy(dtype=float))
    return pd.Series(np.array([two_sided_p(a, b) for a, b in pairs], dtype=float))
