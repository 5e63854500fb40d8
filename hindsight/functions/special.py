"""Special functions for what Spark lacks, vectorised over numpy arrays and wrapped as pandas UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LGAMMA = np.vectorize(math.lgamma, otypes=[float])
_ERFC = np.vectorize(math.erfc, otypes=[float])


def log_gamma_upper(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """ln Q(a, x): by the series of P below a + 1, by the continued fraction above; it does not underflow."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.zeros(a.shape)
    low = (x > 0) & (x < a + 1)
    if low.any():
        out[low] = np.log1p(-np.minimum(np.exp(_log_p_series(a[low], x[low])), 1 - 1e-300))
    high = x >= a + 1
    if high.any():
        out[high] = _log_q_fraction(a[high], x[high])
    return np.minimum(out, 0.0)


def log_gamma_lower(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """ln P(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, -np.inf)
    low = (x > 0) & (x < a + 1)
    if low.any():
        out[low] = _log_p_series(a[low], x[low])
    high = x >= a + 1
    if high.any():
        out[high] = np.log1p(-np.exp(np.minimum(_log_q_fraction(a[high], x[high]), -1e-300)))
    return np.minimum(out, 0.0)


def _log_p_series(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    term, total, k = 1 / a, 1 / a, 0
    while k < 100_000:
        k += 1
        term = term * x / (a + k)
        total = total + term
        if (np.abs(term) <= np.abs(total) * 1e-16).all():
            break
    return np.log(total) + a * np.log(x) - x - _LGAMMA(a)


def _log_q_fraction(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    tiny = 1e-300
    b = x + 1 - a
    c, d = np.full(a.shape, 1 / tiny), 1 / np.where(b == 0, tiny, b)
    h = d.copy()
    for i in range(1, 100_000):
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + an / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        step = d * c
        h = h * step
        if (np.abs(step - 1) < 1e-15).all():
            break
    return np.log(h) + a * np.log(x) - x - _LGAMMA(a)


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction on the side where that converges fast."""
    a, b, x = (v.astype(float) for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    inner = (y > 0) & (y < 1)
    yy = np.where(inner, y, 0.5)
    front = np.exp(_LGAMMA(p + q) - _LGAMMA(p) - _LGAMMA(q) + p * np.log(yy) + q * np.log1p(-yy)) / p
    tiny = 1e-300
    c, d = np.ones(p.shape), 1 - (p + q) * yy / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 2000):
        for num in (m * (q - m) * yy / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * yy / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    v = np.where(inner, front * h, np.where(y >= 1, 1.0, 0.0))
    return np.where(swap, 1 - v, v)


def beta_quantile(p: float, a: float, b: float) -> float:
    """By 200 bisections."""
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_inc(np.array([a]), np.array([b]), np.array([mid]))[0] < p else (lo, mid)
    return (lo + hi) / 2


def clopper_pearson(hits: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    if n == 0:
        return 0.0, 1.0
    return (0.0 if hits == 0 else beta_quantile(alpha / 2, hits, n - hits + 1)), (1.0 if hits == n else beta_quantile(1 - alpha / 2, hits + 1, n - hits))


def log_beta_binomial_tail(k: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln P(K >= k), K beta-binomial with m trials: summed on the side with fewer terms."""
    out = np.zeros(len(k))
    for i in range(len(k)):
        ki, mi, ai, bi = int(k[i]), int(m[i]), float(a[i]), float(b[i])
        if ki <= 0:
            continue
        upper = mi - ki + 1 <= ki
        j = np.arange(ki, mi + 1) if upper else np.arange(0, ki)
        terms = math.lgamma(mi + 1) - _LGAMMA(j + 1) - _LGAMMA(mi - j + 1) + _LGAMMA(j + ai) + _LGAMMA(mi - j + bi) - math.lgamma(mi + ai + bi) - (math.lgamma(ai) + math.lgamma(bi) - math.lgamma(ai + bi))
        top = terms.max()
        s = top + math.log(np.exp(terms - top).sum())
        out[i] = min(0.0, s) if upper else math.log1p(-min(1 - 1e-16, math.exp(s)))
    return out


def mcnemar(b: int, c: int) -> float:
    """Exact binomial below 25 discordant pairs, else chi-square with one degree and continuity correction."""
    n = b + c
    if n == 0:
        return 1.0
    if n < 25:
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n)
    return math.erfc(math.sqrt((abs(b - c) - 1) ** 2 / n / 2))


def splitmix64(state: int) -> tuple[int, int]:
    """The next state and number of the generator."""
    mask = (1 << 64) - 1
    state = (state + 0x9E3779B97F4A7C15) & mask
    z = state
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
    return state, z ^ (z >> 31)


def fnv1a64(text: str) -> int:
    h = 0xCBF29CE484222325
    for byte in text.encode():
        h = ((h ^ byte) * 0x100000001B3) & ((1 << 64) - 1)
    return h


def bessel_ratios(kappa: float, n: int) -> list[float]:
    """I_h(kappa) / I_0(kappa) for h = 1..n, by backward recurrence of ratios."""
    r = 0.0
    ratios = []
    for h in range(n + 60, 0, -1):
        r = 1 / (2 * h / kappa + r)
        if h <= n:
            ratios.append(r)
    out, v = [], 1.0
    for r in reversed(ratios):
        v *= r
        out.append(v)
    return out


@F.pandas_udf(T.DoubleType())
def normal_lower(z: pd.Series) -> pd.Series:
    return pd.Series(0.5 * _ERFC(-z.to_numpy(float) / math.sqrt(2)))


@F.pandas_udf(T.DoubleType())
def normal_upper(z: pd.Series) -> pd.Series:
    return pd.Series(0.5 * _ERFC(z.to_numpy(float) / math.sqrt(2)))


@F.pandas_udf(T.DoubleType())
def chi2_log_survival(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(log_gamma_upper(dof.to_numpy(float) / 2, x.to_numpy(float) / 2))


@F.pandas_udf(T.DoubleType())
def gamma_log_lower(a: pd.Series, x: pd.Series) -> pd.Series:
    return pd.Series(log_gamma_lower(a.to_numpy(float), x.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def least_span(kappa: pd.Series, theta: pd.Series, spans: pd.Series) -> pd.Series:
    """The least ln P(a, x) over a row's spans, of which the i-th from 0 has a = (i + 2) kappa and x = span / theta; null without spans."""
    out = np.full(len(spans), np.nan)
    rows = np.flatnonzero(spans.notna().to_numpy())
    if len(rows):
        lists = [np.asarray(x, float) for x in spans.to_numpy()[rows]]
        sizes = np.array([len(x) for x in lists])
        starts = np.cumsum(sizes) - sizes
        i = np.arange(sizes.sum()) - np.repeat(starts, sizes)
        k, t = np.repeat(kappa.to_numpy(float)[rows], sizes), np.repeat(theta.to_numpy(float)[rows], sizes)
        out[rows] = np.fmin.reduceat(log_gamma_lower((i + 2) * k, np.concatenate(lists) / t), starts)
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def beta_binomial_log_tail(k: pd.Series, m: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(log_beta_binomial_tail(k.to_numpy(), m.to_numpy(), a.to_numpy(float), b.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def beta_lower(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
    return pd.Series(beta_inc(a.to_numpy(float), b.to_numpy(float), x.to_numpy(float)))


@F.pandas_udf(T.StringType())
def fnv1a(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else str(fnv1a64(t)))


@F.pandas_udf(T.IntegerType())
def splitmix_fold(index: pd.Series, seed: pd.Series, folds: pd.Series) -> pd.Series:
    """The finaliser of the splitmix generator on seed + index, modulo the number of folds."""
    with np.errstate(over="ignore"):
        z = index.to_numpy().astype(np.uint64) + seed.to_numpy().astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return pd.Series((z % folds.to_numpy().astype(np.uint64)).astype(np.int32))
