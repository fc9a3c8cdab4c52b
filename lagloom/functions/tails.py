"""Tail probabilities and quantiles of the normal, t, F and chi-square laws.

All functions take arrays, so they also serve inside pandas UDFs. The
incomplete beta and gamma functions use their published continued fractions
and series."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300
_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_two_sided(z) -> np.ndarray:
    return _erfc(np.abs(np.asarray(z, float)) / math.sqrt(2.0))


def _beta_fraction(x, a, b, steps: int = 400):
    """Continued fraction of the incomplete beta by the modified Lentz method."""
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, steps):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + top * d
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1.0 + top / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return h


def beta_cdf(x, a, b) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b)."""
    x, a, b = np.broadcast_arrays(*[np.asarray(v, float) for v in (x, a, b)])
    inner = np.clip(x, 1e-300, 1.0 - 1e-16)
    front = np.exp(
        _lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-inner)
    )
    flip = inner > (a + 1.0) / (a + b + 2.0)
    xx = np.where(flip, 1.0 - inner, inner)
    aa, bb = np.where(flip, b, a), np.where(flip, a, b)
    part = front * _beta_fraction(xx, aa, bb) / aa
    out = np.where(flip, 1.0 - part, part)
    return np.where(x <= 0.0, 0.0, np.where(x >= 1.0, 1.0, out))


def _gamma_upper(a, x, steps: int = 2000):
    """Regularised upper incomplete gamma Q(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    safe = np.maximum(x, 1e-300)
    front = np.exp(-safe + a * np.log(safe) - _lgamma(a))
    # Series for small x.
    term = 1.0 / a
    total = term.copy()
    for k in range(1, steps):
        term = term * safe / (a + k)
        total = total + term
        if np.all(term <= total * 1e-16):
            break
    lower = front * total
    # Continued fraction for large x.
    b = safe + 1.0 - a
    b = np.where(np.abs(b) < _TINY, _TINY, b)
    c, d = np.full_like(safe, 1.0 / _TINY), 1.0 / b
    h = d.copy()
    for i in range(1, steps):
        an = -i * (i - a)
        b = b + 2.0
        d = an * d + b
        d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
        c = b + an / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return np.where(x <= 0.0, 1.0, np.where(safe < a + 1.0, 1.0 - lower, front * h))


def chi2_upper(q, df) -> np.ndarray:
    with np.errstate(all="ignore"):
        return _gamma_upper(np.asarray(df, float) / 2.0, np.asarray(q, float) / 2.0)


def t_two_sided(t, df) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_cdf(df / (df + t * t), df / 2.0, 0.5)


def f_upper(f, d1, d2) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0)


def t_quantile(p: float, df) -> np.ndarray:
    """Upper quantile of Student t for p > 0.5, by bisection on the tail."""
    df = np.asarray(df, float)
    lo, hi = np.zeros_like(df), np.full_like(df, 2.0)
    target = 2.0 * (1.0 - p)
    while np.any(grow := t_two_sided(hi, df) > target):
        hi = np.where(grow, hi * 4.0, hi)
    for _ in range(120):
        mid = 0.5 * (lo + hi)
        above = t_two_sided(mid, df) > target
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return 0.5 * (lo + hi)


def _tail_column(fn: Callable, *cols: Column) -> Column:
    """A tail as a column; used on small result tables only."""

    @F.pandas_udf("double")
    def tail(frame: pd.DataFrame) -> pd.Series:
        values = frame.to_numpy(dtype=float)
        ok = np.isfinite(values).all(axis=1)
        out = np.full(len(values), np.nan)
        if ok.any():
            out[ok] = fn(*values[ok].T)
        return pd.Series(out).astype(object).where(ok, None)

    return tail(F.struct(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(cols)]))


def normal_p(z: Column) -> Column:
    return _tail_column(normal_two_sided, z)


def chi2_p(q: Column, df: Column) -> Column:
    return _tail_column(chi2_upper, q, df)


def t_p(t: Column, df: Column) -> Column:
    return _tail_column(t_two_sided, t, df)


def f_p(f: Column, d1: Column, d2: Column) -> Column:
    return _tail_column(f_upper, f, d1, d2)


def t_crit(level: float, df: Column) -> Column:
    return _tail_column(lambda d: t_quantile(0.5 + level / 2.0, d), df)
