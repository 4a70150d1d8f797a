"""Special functions as Column expressions, and an exact Student tail in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The coefficients of the rational Chebyshev form of erfc, highest order last.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    """Complementary error function, relative error below 1.2e-7."""
    u = F.abs(x)
    s = 1.0 / (1.0 + u * 0.5)
    series = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        series = F.lit(c) + s * series
    tail = s * F.exp(-u * u + series)
    return F.when(x >= 0, tail).otherwise(2.0 - tail)


def erfc_sql(x: str) -> str:
    """The same expression as SQL text that Spark and DuckDB share."""
    s = f"(1.0 / (1.0 + abs({x}) * 0.5))"
    series = f"CAST({ERFC[-1]} AS DOUBLE)"
    for c in reversed(ERFC[:-1]):
        series = f"(CAST({c} AS DOUBLE) + {s} * {series})"
    tail = f"({s} * exp(-abs({x}) * abs({x}) + {series}))"
    return f"(CASE WHEN {x} >= 0 THEN {tail} ELSE 2.0 - {tail} END)"


def normal_two_sided(z: Column) -> Column:
    """Two-sided tail of the standard normal, at most 1."""
    return F.least(F.lit(1.0), erfc(z / float(np.sqrt(2.0))))


def student_two_sided_fast(t: Column, df: Column) -> Column:
    """Quick two-sided tail: exact for 2 degrees of freedom, normal above 30."""
    low = 2.0 * (1.0 - 0.5 * (1.0 + F.abs(t) / F.sqrt(df + t * t)))
    return F.when(df > 30, normal_two_sided(F.abs(t) / F.sqrt(1.0 + t * t / df))).otherwise(F.least(F.lit(1.0), low))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            c = 1.0 + step / c
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-14):
            break
    return h


def student_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Exact two-sided tail of Student's distribution for arrays."""
    from math import lgamma

    a, b = df / 2.0, np.full_like(df, 0.5)
    x = df / (df + t * t)
    log_beta = np.array([lgamma(p + 0.5) - lgamma(p) - lgamma(0.5) for p in a])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(log_beta + a * np.log(x) + b * np.log1p(-x))
        direct = x < (a + 1.0) / (a + b + 2.0)
        value = np.where(direct, front * _beta_fraction(a, b, x) / a, 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b)
    return np.where(t == 0, 1.0, np.clip(value, 0.0, 1.0))


def student_two_sided_exact(t: Column, df: Column) -> Column:
    """The exact tail as a Column, computed in Arrow batches."""

    def tail(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, n in batches:
            out = np.full(len(x), np.nan)
            ok = (x.notna() & n.notna() & (n > 0)).to_numpy()
            if ok.any():
                out[ok] = student_two_sided(x.to_numpy(float)[ok], n.to_numpy(float)[ok])
            yield pd.Series(out)

    return F.pandas_udf(tail, "double")(t, df)
