"""Tail probabilities that Spark has no built-in for, as Arrow-batched UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma of positive numbers: ten steps of the recurrence, then Stirling's series."""
    x = np.asarray(x, float)
    steps = sum(np.log(x + i) for i in range(10))
    x, y = x + 10, 1 / (x + 10) ** 2
    series = (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y / 1188)))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series - steps


def _normal_two_sided(z: np.ndarray) -> np.ndarray:
    """P(|Z| >= |z|): the incomplete gamma function at 1/2, by series or by fraction."""
    x = z * z / 2
    out = np.ones_like(x)
    small = (x > 0) & (x < 1.5)
    if small.any():
        v = x[small]
        term = total = np.full_like(v, 2.0)
        for n in range(1, 60):
            term = term * v / (n + 0.5)
            total = total + term
        out[small] = 1 - total * np.exp(-v) * np.sqrt(v / math.pi)
    large = x >= 1.5
    if large.any():
        v = x[large]
        fraction = np.zeros_like(v)
        for n in range(200, 0, -1):
            fraction = n * (n - 0.5) / (v + 2 * n + 0.5 - fraction)
        out[large] = np.exp(-v) * np.sqrt(v / math.pi) / (v + 0.5 - fraction)
    return out


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz).

    The number of steps it needs grows with the root of the larger parameter.
    """
    tiny = 1e-300
    steps = 300 + int(5 * math.sqrt(max(a.max(), b.max())))
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps + 1):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return h


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b), element by element."""
    a, b, x = np.broadcast_arrays(
        np.asarray(a, float), np.asarray(b, float), np.asarray(x, float)
    )
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(a) & np.isfinite(b) & (x >= 0) & (x <= 1)
    inner = ok & (x > 0) & (x < 1)
    out[ok & (x == 0)] = 0.0
    out[ok & (x == 1)] = 1.0
    if inner.any():
        a, b, x = a[inner], b[inner], x[inner]
        # The fraction converges fast only left of the mean; use symmetry beyond.
        swap = x > (a + 1) / (a + b + 2)
        p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
        log_front = (
            _lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)
        )
        value = np.exp(log_front) * _fraction(p, q, z) / p
        out[inner] = np.where(swap, 1 - value, value)
    return out


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) for Student's t; normal limit for infinite df."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    out = np.full(t.shape, np.nan)
    limit = np.isinf(df) & np.isfinite(t)
    if limit.any():
        out[limit] = _normal_two_sided(t[limit])
    known = np.isfinite(t) & np.isfinite(df) & (df > 0)
    if known.any():
        d = df[known]
        out[known] = incomplete_beta(d / 2, 0.5, d / (d + t[known] ** 2))
    return out


def chi2_upper(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(chi-square > x), the incomplete gamma function by series or by fraction."""
    x, df = np.broadcast_arrays(np.asarray(x, float) / 2, np.asarray(df, float) / 2)
    out = np.where(x > 0, np.nan, 1.0)
    out[x == np.inf] = 0.0
    front = np.exp(df * np.log(np.where(x > 0, x, 1.0)) - x - _lgamma(df))
    small = (x > 0) & (x < df + 1)
    if small.any():
        a, v = df[small], x[small]
        term = total = 1 / a
        for n in range(1, 300 + int(10 * math.sqrt(a.max()))):
            term = term * v / (a + n)
            total = total + term
        out[small] = 1 - front[small] * total
    large = (x >= df + 1) & np.isfinite(x)
    if large.any():
        a, v = df[large], x[large]
        fraction = np.zeros_like(v)
        for n in range(300 + int(10 * math.sqrt(a.max())), 0, -1):
            fraction = n * (n - a) / (v + 2 * n + 1 - a - fraction)
        out[large] = front[large] / (v + 1 - a - fraction)
    return out


def f_upper(ratio: np.ndarray, df: np.ndarray, prior_df: np.ndarray) -> np.ndarray:
    """P(F > ratio) of F on ``df`` and ``prior_df``; infinite ``prior_df`` is a chi-square."""
    ratio, df, prior_df = np.broadcast_arrays(
        np.asarray(ratio, float), np.asarray(df, float), np.asarray(prior_df, float)
    )
    out = np.full(ratio.shape, np.nan)
    limit = np.isinf(prior_df) & (ratio >= 0) & (df > 0)
    if limit.any():
        out[limit] = chi2_upper(df[limit] * ratio[limit], df[limit])
    known = np.isfinite(prior_df) & (prior_df > 0) & (ratio >= 0) & (df > 0)
    if known.any():
        d = prior_df[known]
        out[known] = incomplete_beta(d / 2, df[known] / 2, d / (d + df[known] * ratio[known]))
    return out


def _nullable(values: np.ndarray) -> pd.Series:
    return pd.Series(values).where(~np.isnan(values), None).astype("Float64")


def _student_t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _nullable(t_two_sided(t.to_numpy(float), df.to_numpy(float)))


# Marked so that a filter on the result is not pushed below and the tail worked out
# a second time; the values do not vary.
student_t_p = F.pandas_udf(_student_t_p, T.DoubleType()).asNondeterministic()


def _f_upper_tail(ratio: pd.Series, df: pd.Series, prior_df: pd.Series) -> pd.Series:
    return _nullable(f_upper(ratio.to_numpy(float), df.to_numpy(float), prior_df.to_numpy(float)))


f_upper_tail = F.pandas_udf(_f_upper_tail, T.DoubleType()).asNondeterministic()


def _shifted(x: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    """Ten steps of the recurrence: the sum they contribute and the raised argument."""
    x = np.asarray(x, float)
    return sum(1.0 / (x + i) ** power for i in range(10)), x + 10


def digamma(x: np.ndarray | float) -> np.ndarray:
    """Derivative of log gamma: recurrence, then the asymptotic series."""
    steps, x = _shifted(x, 1)
    y = 1 / (x * x)
    tail = y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))
    return np.log(x) - 0.5 / x - tail - steps


def trigamma(x: np.ndarray | float) -> np.ndarray:
    """Second derivative of log gamma."""
    steps, x = _shifted(x, 2)
    y = 1 / (x * x)
    tail = y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y * (1 / 30 - y * 5 / 66))))
    return steps + 1 / x + y / 2 + tail


def inverse_trigamma(target: float) -> float:
    """Solve trigamma(x) = target by bisection on a log scale (it only falls)."""
    low, high = 1e-8, 1e8
    for _ in range(200):
        mid = math.sqrt(low * high)
        if trigamma(mid) > target:
            low = mid
        else:
            high = mid
    return math.sqrt(low * high)


def winsorised_log_ratio(
    df: float, prior_df: float, tails: tuple[float, float], points: int = 1500
) -> tuple[float, float]:
    """Mean and variance of log F(df, prior_df) with both tails pulled in.

    The lower share ``tails[0]`` and the upper share ``tails[1]`` are set to the
    quantiles where they start.  Sums over a fine grid of the distribution.
    """
    half = 12 * math.sqrt(float(trigamma(df / 2)) + float(trigamma(prior_df / 2)))
    centre = float(digamma(df / 2) - digamma(prior_df / 2)) - math.log(df / prior_df)
    z = np.linspace(centre - half, centre + half, points)
    scaled = df * np.exp(z)
    below = incomplete_beta(df / 2, prior_df / 2, scaled / (scaled + prior_df))
    low, high = np.interp([tails[0], 1 - tails[1]], below, z)
    values = np.clip((z[1:] + z[:-1]) / 2, low, high)
    share = np.diff(below)
    share = share / share.sum()
    mean = float((values * share).sum())
    return mean, float((share * (values - mean) ** 2).sum())


@F.pandas_udf(T.DoubleType())
def log_variance_shift(df: pd.Series) -> pd.Series:
    """Mean of the log of a unit variance estimate on ``df`` degrees of freedom."""
    half = df.to_numpy(float) / 2
    return pd.Series(digamma(half) - np.log(half))


@F.pandas_udf(T.DoubleType())
def log_variance_noise(df: pd.Series) -> pd.Series:
    """Variance of the log of a variance estimate on ``df`` degrees of freedom."""
    return pd.Series(trigamma(df.to_numpy(float) / 2))
