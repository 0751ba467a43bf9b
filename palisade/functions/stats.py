"""Statistical column functions; those without a closed SQL form are vectorised pandas UDFs over whole batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions.sequence import col


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def logit(p: str | Column) -> Column:
    q = clamp(col(p), 1e-9, 1 - 1e-9)
    return F.log(q / (1 - q))


def inv_logit(x: str | Column) -> Column:
    return 1.0 / (1.0 + F.exp(-col(x)))


def phred_error(q: str | Column) -> Column:
    """Error probability of a quality character."""
    return F.pow(F.lit(10.0), -clamp((F.ascii(col(q)) - 33).cast("double"), 0, 60) / 10)


def coding_score(x: str | Column) -> Column:
    return 1.0 / (1.0 + F.exp(-22.0 * (col(x) - 0.85)))


def call_confidence(length: str | Column, coding: str | Column) -> Column:
    """Geometric mean of a length term and the coding probability."""
    return F.sqrt(col(coding) / (1.0 + F.exp(-0.12 * (col(length) - 25))))


def decay(d_max: float | Column, rate: float | Column, distance: Column) -> Column:
    """Damage probability at a distance from the terminus."""
    return F.lit(d_max) * F.exp(-F.lit(rate) * distance)


def wilson(k: str | Column, n: str | Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; (0, 0) for n <= 0. k and n may be effective (fractional) counts."""
    k, n = col(k), col(n)
    p = k / n
    den = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / den
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / den
    low, high = F.greatest(mid - half, F.lit(0.0)), F.least(mid + half, F.lit(1.0))
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(0.0)


def log10_evalue(e: str | Column) -> Column:
    return F.when(col(e) > 0, F.log10(col(e))).otherwise(F.lit(-300.0))


def quantize_probability(p: str | Column) -> Column:
    return F.round(clamp(col(p), 0, 1) * 255).cast("short")


def quantize_percent(p: str | Column) -> Column:
    return F.round(clamp(col(p) * 2, 0, 200)).cast("short")


def dequantize_probability(q: str | Column) -> Column:
    return col(q) / F.lit(255.0)


def dequantize_percent(q: str | Column) -> Column:
    return col(q) / F.lit(2.0)


def binomial_ll(k: str | Column, n: str | Column, p: str | Column) -> Column:
    q = clamp(col(p), 1e-10, 1 - 1e-10)
    return col(k) * F.log(q) + (col(n) - col(k)) * F.log(1 - q)


#: Lanczos coefficients (g = 7).
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def lgamma(x: np.ndarray) -> np.ndarray:
    """Log-gamma of positive numbers."""
    x = np.asarray(x, float) - 1
    s = np.full(x.shape, _LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        s = s + c / (x + i)
    t = x + 7.5
    return 0.5 * np.log(2 * np.pi) + (x + 0.5) * np.log(t) - t + np.log(s)


def lbeta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return lgamma(a) + lgamma(b) - lgamma(np.asarray(a) + np.asarray(b))


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        out = np.where(small, out - 1 / np.where(small, x, 1), out)
        x = np.where(small, x + 1, x)
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def trigamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        out = np.where(small, out + 1 / np.where(small, x, 1) ** 2, out)
        x = np.where(small, x + 1, x)
    f = 1 / (x * x)
    return out + 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30)))


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction (modified Lentz), vectorised."""
    x, a, b = np.broadcast_arrays(np.clip(np.asarray(x, float), 0, 1), np.asarray(a, float), np.asarray(b, float))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(p * np.log(y) + q * np.log1p(-y) - lbeta(p, q)) / p
    tiny = 1e-300
    c = np.ones_like(y)
    d = 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 200):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    out = np.where(y <= 0, 0.0, np.nan_to_num(front) * h)
    return np.where(flip, 1 - out, out)


def beta_quantile(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By bisection."""
    p, a, b = np.broadcast_arrays(np.asarray(p, float), np.asarray(a, float), np.asarray(b, float))
    lo, hi = np.zeros(p.shape), np.ones(p.shape)
    for _ in range(60):
        mid = (lo + hi) / 2
        low = beta_cdf(mid, a, b) < p
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return (lo + hi) / 2


@F.pandas_udf(T.DoubleType())
def log_gamma(x: pd.Series) -> pd.Series:
    return pd.Series(lgamma(x.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def log_beta_binomial(k: pd.Series, n: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """Log-probability of k of n under a beta-binomial; k and n may be fractional."""
    k, n, a, b = (s.to_numpy(float) for s in (k, n, a, b))
    return pd.Series(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + lbeta(k + a, n - k + b) - lbeta(a, b))


@F.pandas_udf(T.DoubleType())
def beta_below(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(beta_cdf(x, a, b))


@F.pandas_udf(T.DoubleType())
def beta_at(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(beta_quantile(p, a, b))


_FIT = T.StructType([T.StructField(c, T.DoubleType()) for c in ("p_damaged", "delta_mle", "ci_lower", "ci_upper", "lrt_pvalue", "log_bf")])
_EDGE = 1e-6


def fit_share(n: np.ndarray, k: np.ndarray, k2: np.ndarray, alpha: float = 1.0, beta: float = 1.0) -> dict[str, np.ndarray]:
    """Beta-binomial share of damage of n reads with sum k and sum of squares k2 of their probabilities.

    The concentration comes from the moments (the share under a Beta(alpha, beta) prior, the variance of the reads) and is
    held; the share maximises the likelihood, found on a grid and then between its neighbours. Interval: where the
    likelihood has fallen by 1.92; test and Bayes factor: against no damage at all, with the curvature at the maximum."""
    from math import erfc

    some = n > 0
    m = np.where(some, n, 1)
    guess = np.clip((k + alpha) / (n + alpha + beta), 0.01, 0.99)
    phi = np.clip(guess * (1 - guess) / np.maximum(k2 / m - (k / m) ** 2, 1e-6) - 1, 2, 1000)

    def ll(t):
        a, b = t * phi, (1 - t) * phi
        return lbeta(k + a, n - k + b) - lbeta(a, b)

    grid = np.linspace(0.0, 1.0, 101).clip(_EDGE, 1 - _EDGE)
    at = np.stack([ll(np.full_like(guess, g)) for g in grid]).argmax(axis=0)
    lo, hi = grid[np.maximum(at - 1, 0)], grid[np.minimum(at + 1, 100)]
    for _ in range(40):  # the maximum lies between: thirds
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = ll(a) > ll(b)
        lo, hi = np.where(left, lo, a), np.where(left, b, hi)
    t = (lo + hi) / 2
    top = ll(t)

    def fallen(inner, outer):
        for _ in range(40):  # halves
            mid = (inner + outer) / 2
            near = top - ll(mid) < 1.92
            inner, outer = np.where(near, mid, inner), np.where(near, outer, mid)
        return (inner + outer) / 2

    down, up = fallen(t, np.full_like(t, _EDGE)), fallen(t, np.full_like(t, 1 - _EDGE))
    c, h = np.clip(t, 1e-3, 1 - 1e-3), 1e-4
    bend = np.maximum(np.abs(ll(c + h) - 2 * ll(c) + ll(c - h)) / h ** 2, 1e-9)
    gain = np.maximum(0.0, top - ll(np.full_like(t, _EDGE)))
    bf = gain + 0.5 * np.log(2 * np.pi / bend)
    pick = lambda x, e: np.where(some, x, e)
    return {"p_damaged": pick(1 / (1 + np.exp(-np.clip(bf, -100, 100))), 0.5), "delta_mle": pick(t, 0.0), "ci_lower": pick(down, 0.0), "ci_upper": pick(up, 1.0), "lrt_pvalue": pick([erfc(x ** 0.5) for x in gain], 1.0), "log_bf": pick(bf, 0.0)}


def protein_damage(n: str | Column, k: str | Column, k2: str | Column, alpha: float = 1.0, beta: float = 1.0) -> Column:
    """Struct of fit_share(); nulls count as 0."""

    @F.pandas_udf(_FIT)
    def run(n: pd.Series, k: pd.Series, k2: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(fit_share(*(s.fillna(0).to_numpy(float) for s in (n, k, k2)), alpha, beta))

    return run(col(n), col(k), col(k2))
