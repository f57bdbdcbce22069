"""Binomial, Poisson and multinomial probabilities, for scalars and numpy arrays, and as
Arrow functions; Spark SQL has no log-gamma."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def log_binomial(n: float, k: float, p: float) -> float:
    """Log of the binomial probability of k of n; -inf if it cannot be."""
    if k < 0 or k > n:
        return -math.inf
    p = min(max(p, 0.0), 1.0)
    if (p == 0 and k > 0) or (p == 1 and k < n):
        return -math.inf
    out = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    if k:
        out += k * math.log(p)
    if n - k:
        out += (n - k) * math.log1p(-p)
    return out


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k)."""
    if k <= 0:
        return 1.0
    return 0.0 if k > n else beta_cdf(p, k, n - k + 1)


def poisson_tail(k: int, mean: float) -> float:
    """P(X >= k), summed upward from k where that is the shorter side."""
    if k <= 0:
        return 1.0
    if mean <= 0:
        return 0.0
    if k > mean:
        term = math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        total, i = 0.0, k
        while term > 0:
            total += term
            i += 1
            term *= mean / i
            if term < total * 1e-17:
                break
        return min(total, 1.0)
    term, total = math.exp(-mean), 0.0
    if term == 0:
        return 1 - sum(math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(k))
    for i in range(k):
        total += term
        term *= mean / (i + 1)
    return max(0.0, 1 - total)


def detection_threshold(n: int, p: float, alpha: float) -> int:
    """The least k with P(X >= k) < alpha."""
    low, high = 0, n + 1
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if binomial_tail(mid, n, p) < alpha else (mid + 1, high)
    return low


def limit_of_detection(n: int, p_err: float, recall: float, fpr: float) -> float | None:
    """The least fraction whose signal passes the threshold with ``recall``."""
    k = detection_threshold(n, p_err, fpr)
    reach = lambda tf: binomial_tail(k, n, min(1.0, tf + p_err * (1 - tf)))
    if n <= 0 or reach(1.0) < recall:
        return None
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if reach(mid) < recall else (low, mid)
    return high


def multinomial(actual: list[float], expected: list[float]) -> float:
    """Multinomial probability of counts under the shares of ``expected``."""
    n, total = sum(actual), sum(expected)
    out = math.lgamma(n + 1)
    for a, e in zip(actual, expected):
        if e <= 0 and a > 0:
            return 0.0
        out += (a * math.log(e / total) if a else 0.0) - math.lgamma(a + 1)
    return math.exp(out)


def multinomial_ratio(actual: list[float], expected: list[float]) -> float:
    """The probability over the most that any shares could give."""
    best = multinomial(actual, [max(a, 1e-300) for a in actual])
    return multinomial(actual, expected) / best if best else 0.0


def library_size(n: float, c: float, rounds: int = 50) -> float | None:
    """x with x (1 - exp(-n / x)) = c distinct of n reads, by Newton's method."""
    if not 0 < c < n:
        return None
    x = c * c / max(2 * (n - c), 1e-9) + c
    for _ in range(rounds):
        e = math.exp(-n / x)
        step = (x * (1 - e) - c) / (1 - e * (1 + n / x))
        x -= step
        if abs(step) < 1e-9 * x:
            break
    return x


def arrow(fn: Callable[..., float], *columns: Column) -> Column:
    """A scalar function over Arrow batches; null if an argument is."""

    @F.pandas_udf(T.DoubleType())
    def run(*args: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else fn(*row) for row in zip(*args)], dtype="float64")

    return run(*columns)
