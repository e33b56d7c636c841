"""lgamma and digamma, which Spark SQL lacks, as numpy functions and Arrow UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

#: Coefficients of the asymptotic series of digamma (Bernoulli numbers / 2n).
_SERIES = (1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132, -691 / 32760, 1 / 12)
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def lgamma(x) -> np.ndarray:
    return _lgamma(np.asarray(x, float))


def digamma(x) -> np.ndarray:
    """For positive x: raised above 6 by the recurrence, then the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (low := x < 6).any():
        out = np.where(low, out - 1 / np.where(low, x, 1), out)
        x = np.where(low, x + 1, x)
    inv = 1 / (x * x)
    series = sum(c * inv ** (k + 1) for k, c in enumerate(_SERIES))
    return out + np.log(x) - 0.5 / x - series


def trigamma(x) -> np.ndarray:
    """Derivative of digamma, the same way; the series' terms are those above times 2k x^-1."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (low := x < 6).any():
        out = np.where(low, out + 1 / np.where(low, x, 1) ** 2, out)
        x = np.where(low, x + 1, x)
    inv = 1 / (x * x)
    series = sum(2 * (k + 1) * c * inv ** (k + 1) for k, c in enumerate(_SERIES)) / x
    return out + 1 / x + inv / 2 + series


def bisect(f, low: np.ndarray, high: np.ndarray, steps: int = 100, eps: float = 1e-9) -> np.ndarray:
    """Roots of an increasing f, element by element."""
    low, high = np.array(low, float), np.array(high, float)
    for _ in range(steps):
        mid = (low + high) / 2
        up = f(mid) < 0
        low, high = np.where(up, mid, low), np.where(up, high, mid)
        if (high - low).max(initial=0) < eps:
            break
    return (low + high) / 2


@pandas_udf(DoubleType())
def lgamma_udf(x: pd.Series) -> pd.Series:
    return pd.Series(lgamma(x.to_numpy()))


@pandas_udf(DoubleType())
def digamma_udf(x: pd.Series) -> pd.Series:
    return pd.Series(digamma(x.to_numpy()))
