"""Tail probabilities. Spark has no F distribution, so that part is vectorised numpy."""

from __future__ import annotations

from math import lgamma

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the asymptotic two-sample Kolmogorov p-value: small-sample correction
# (sqrt(m) + 0.12 + 0.11 / sqrt(m)) and the point below which p rounds to one.
KS_CORRECTION = (0.12, 0.11)
KS_SURE = 0.2
KS_TERMS = 20  # the 20th term is below 1e-13 from KS_SURE on

Z_99 = 2.576  # fixed value: two-sided 99% normal quantile


def ks_pvalue(d: Column, n_a: Column, n_b: Column) -> Column:
    """P-value of a two-sample gap ``d`` by the Kolmogorov series."""
    a, b = n_a.cast("double"), n_b.cast("double")
    root = F.sqrt(a * b / (a + b))
    lam = (root + KS_CORRECTION[0] + KS_CORRECTION[1] / root) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(KS_TERMS)),
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(F.lit(-2.0) * k * k * lam * lam),
    )
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), series))
    return F.when(d.isNull(), None).when(lam < KS_SURE, F.lit(1.0)).otherwise(clipped)


def beta_tail(x: np.ndarray, a: float, b: float) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b) by Lentz's continued fraction."""
    x = np.clip(np.asarray(x, dtype=float), 0.0, 1.0)
    turn = x > (a + 1.0) / (a + b + 2.0)
    out = np.empty_like(x)
    for flip, (p, q) in ((False, (a, b)), (True, (b, a))):
        rows = turn == flip
        z = 1.0 - x[rows] if flip else x[rows]
        with np.errstate(divide="ignore", invalid="ignore"):
            front = np.exp(
                lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(z) + q * np.log1p(-z)
            )
        front = np.nan_to_num(front, nan=0.0)
        tiny = 1e-300
        c = np.ones_like(z)
        d = 1.0 - (p + q) * z / (p + 1.0)
        d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 300):
            for numer in (
                m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
                -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)),
            ):
                d = 1.0 + numer * d
                d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1.0 + numer / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if z.size == 0 or np.max(np.abs(d * c - 1.0)) < 1e-15:
                break
        part = front * h / p
        out[rows] = 1.0 - part if flip else part
    return out


def f_tail(f: np.ndarray, df: float) -> np.ndarray:
    """P(F(1, df) > f); NaN stays NaN."""
    f = np.asarray(f, dtype=float)
    with np.errstate(invalid="ignore", over="ignore"):
        p = beta_tail(np.where(np.isnan(f), 0.0, df / (df + f)), df / 2.0, 0.5)
    return np.where(np.isnan(f), np.nan, p)


def f_critical(alpha: float, df: float) -> float:
    """The F(1, df) value whose tail is ``alpha`` (bisection on the correlation scale)."""
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2.0
        r2 = mid * mid
        p = float(f_tail(np.array([r2 / max(1e-300, 1.0 - r2) * df]), df)[0])
        low, high = (mid, high) if p > alpha else (low, mid)
    r2 = high * high
    return r2 / max(1e-300, 1.0 - r2) * df


__all__ = ["Z_99", "beta_tail", "f_critical", "f_tail", "ks_pvalue"]
