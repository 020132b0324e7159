"""Functions without a built-in: the normal distribution, and quantiles of gamma, beta and Zipf.

They are numpy code behind Arrow-batched pandas UDFs. Quantiles bisect the regularised
incomplete functions (series and continued fractions by the modified Lentz method).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300
_erfc = np.frompyfunc(math.erfc, 1, 1)


def norm_cdf(z: np.ndarray) -> np.ndarray:
    return _erfc(-np.asarray(z, float) / math.sqrt(2)).astype(float) / 2


def _lentz(first: np.ndarray, term, rounds: int = 300) -> np.ndarray:
    """first + a1/(b1 + a2/(b2 + ...)), (a, b) = term(i)."""
    f = np.where(first == 0, _TINY, first)
    c, d = f.copy(), np.zeros_like(f)
    for i in range(1, rounds):
        a, b = term(i)
        d = b + a * d
        d = 1 / np.where(d == 0, _TINY, d)
        c = b + a / c
        c = np.where(c == 0, _TINY, c)
        step = c * d
        f = f * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    return f


def gamma_cdf(a: float, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function."""
    x = np.maximum(np.asarray(x, float), 0)
    out = np.zeros_like(x)
    low, high = (x > 0) & (x < a + 1), x >= a + 1
    if low.any():
        v = x[low]
        term = total = np.full_like(v, 1 / a)
        for n in range(1, 2000):
            term = term * v / (a + n)
            total = total + term
            if np.all(term < total * 1e-17):
                break
        out[low] = total * np.exp(-v + a * np.log(v) - math.lgamma(a))
    if high.any():
        v = x[high]
        f = _lentz(v + 1 - a, lambda i: (-i * (i - a), v + 2 * i + 1 - a))
        out[high] = 1 - np.exp(-v + a * np.log(v) - math.lgamma(a)) / f
    return out


def beta_cdf(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function."""
    x = np.clip(np.asarray(x, float), 0, 1)

    def left(p: float, q: float, v: np.ndarray) -> np.ndarray:
        def term(i: int) -> tuple[np.ndarray, np.ndarray]:
            m = i // 2
            top = m * (q - m) / ((p + 2 * m - 1) * (p + 2 * m)) if i % 2 == 0 else -(p + m) * (p + q + m) / ((p + 2 * m) * (p + 2 * m + 1))
            return top * v, np.ones_like(v)

        with np.errstate(divide="ignore"):
            front = np.exp(p * np.log(v) + q * np.log1p(-v) + math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q)) / p
        return front / _lentz(np.ones_like(v), term)

    swap = x > (a + 1) / (a + b + 2)
    out = np.empty_like(x)
    out[~swap] = left(a, b, x[~swap])
    out[swap] = 1 - left(b, a, 1 - x[swap])
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def _bisect(cdf, u: np.ndarray, low: float, high: float) -> np.ndarray:
    lo, hi = np.full_like(u, low), np.full_like(u, high)
    for _ in range(1100):
        mid = (lo + hi) / 2
        below = cdf(mid) < u
        done = (mid <= lo) | (mid >= hi)
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        if np.all(done | (hi - lo <= 1e-15 * np.abs(hi))):
            break
    return (lo + hi) / 2


def gamma_ppf(u: np.ndarray, shape: float, scale: float) -> np.ndarray:
    u = np.asarray(u, float)
    high = shape + 10.0
    while u.size and gamma_cdf(shape, np.array([high]))[0] < u.max():
        high *= 2
        if high > 1e12:
            break
    return scale * _bisect(lambda x: gamma_cdf(shape, x), u, 0.0, high)


def beta_ppf(u: np.ndarray, a: float, b: float) -> np.ndarray:
    return _bisect(lambda x: beta_cdf(a, b, x), np.asarray(u, float), 0.0, 1.0)


#: Ranks whose weights are summed one by one; beyond them sums are analytic.
HEAD = 1_000_000


def zipf_cdf(a: float, n: int) -> np.ndarray:
    c = np.cumsum(np.arange(1, n + 1, dtype=float) ** -a)
    return c / c[-1]


def _beyond(a: float, k: np.ndarray, head: int) -> np.ndarray:
    """Sum of j ** -a for head < j <= k, by Euler and Maclaurin: exact to double precision for a large head."""
    k = np.asarray(k, float)
    whole = np.log(k / head) if abs(1 - a) < 1e-12 else (k ** (1 - a) - float(head) ** (1 - a)) / (1 - a)
    return whole + (k**-a - float(head) ** -a) / 2 - a / 12 * (k ** (-a - 1) - float(head) ** (-a - 1))


def harmonic(a: float, n: int, head: int = HEAD) -> float:
    """Sum of j ** -a for 1 <= j <= n, with memory for head numbers at most."""
    first = float((np.arange(1, min(n, head) + 1, dtype=float) ** -a).sum())
    return first if n <= head else first + float(_beyond(a, np.array([n]), head)[0])


def zipf_rank(u: np.ndarray, a: float, n: int, sums: np.ndarray) -> np.ndarray:
    """0-based ranks of uniforms; sums: cumulative weights of the first min(n, HEAD) ranks. Ranks within
    them are those of the whole table; further ones are found by halving the analytic sum."""
    head = len(sums)
    if n <= head:
        return np.clip(np.searchsorted(sums / sums[-1], u, side="left"), 0, n - 1).astype(np.int64)
    want = u * (sums[-1] + float(_beyond(a, np.array([n]), head)[0]))
    out = np.searchsorted(sums, want, side="left").astype(np.int64)
    far = out >= head
    low, high = np.full(far.sum(), head, np.int64), np.full(far.sum(), n, np.int64)
    while (low + 1 < high).any():
        mid = (low + high) // 2
        short = sums[-1] + _beyond(a, mid, head) < want[far]
        low, high = np.where(short, mid, low), np.where(short, high, mid)
    out[far] = high - 1
    return np.clip(out, 0, n - 1)


def _udf(fn, kind: str):
    return F.pandas_udf(lambda s: pd.Series(fn(s.to_numpy())), kind)


def norm_cdf_column(z: Column) -> Column:
    return F.pandas_udf(lambda s: pd.Series(norm_cdf(s.to_numpy())), "double")(z)


def gamma_column(u: Column, shape: float, scale: float) -> Column:
    return _udf(lambda v: gamma_ppf(v, shape, scale), "double")(u)


def beta_column(u: Column, a: float, b: float) -> Column:
    return _udf(lambda v: beta_ppf(v, a, b), "double")(u)


def zipf_column(u: Column, a: float, n: int) -> Column:
    """0-based rank; the table of the first HEAD weights is made once in each worker."""
    made: dict[str, np.ndarray] = {}

    def rank(v: np.ndarray) -> np.ndarray:
        if not made:
            made["sums"] = np.cumsum(np.arange(1, min(n, HEAD) + 1, dtype=float) ** -a)
        return zipf_rank(v, a, n, made["sums"])

    return _udf(rank, "long")(u)
