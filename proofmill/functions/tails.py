"""Tail probabilities of a few test statistics, for rows that are already aggregated; and rank helpers."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

NORMAL = NormalDist()


def chi2_tail(x: float, df: int) -> float:
    """P(X >= x) of the chi-squared distribution with an integer df."""
    if x is None or math.isnan(x):
        return math.nan
    if x <= 0 or df <= 0:
        return 1.0
    half = x / 2
    if df % 2 == 0:
        term = total = math.exp(-half)
        for i in range(1, df // 2):
            term *= half / i
            total += term
        return min(1.0, total)
    total, term = math.erfc(math.sqrt(half)), math.sqrt(2 * x / math.pi) * math.exp(-half)
    for j in range(1, df - 1, 2):
        total += term
        term *= x / (j + 2)
    return min(1.0, total)


def normal_tail(z: float) -> float:
    """Two-sided tail of the standard normal distribution."""
    return math.erfc(abs(z) / math.sqrt(2))


def binomial_two_sided(k: int, n: int) -> float:
    """min(1, 2 P[Bin(n, 1/2) <= k]); 1 for n = 0."""
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0


def signed_rank_tail(w: float, n: int, ties: bool, tie_term: float) -> float:
    """Two-sided p of the smaller signed-rank sum: exact for n <= 50 without ties, else normal with the tie term."""
    if n == 0:
        return math.nan
    if n <= 50 and not ties:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    spread = math.sqrt((n * (n + 1) * (2 * n + 1) - tie_term / 2) / 24)
    return normal_tail((w - n * (n + 1) / 4) / spread)


def _poly(c: list[float], x: float) -> float:
    return sum(v * x**i for i, v in enumerate(c))


def shapiro_wilk(xs: list[float]) -> tuple[float | None, float | None]:
    """W and p of the Shapiro-Wilk test (Royston 1995) for at least three values that aren't all equal."""
    x, n = sorted(xs), len(xs)
    if n < 3 or x[0] == x[-1]:
        return None, None
    m = [NORMAL.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    s, r = sum(v * v for v in m), 1 / math.sqrt(n)
    if n == 3:
        a = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    else:
        last = m[-1] / math.sqrt(s) + _poly([0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056], r)
        if n > 5:
            before = m[-2] / math.sqrt(s) + _poly([0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633], r)
            phi = (s - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * before**2)
            a = [-last, -before, *(v / math.sqrt(phi) for v in m[2:-2]), before, last]
        else:
            phi = (s - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = [-last, *(v / math.sqrt(phi) for v in m[1:-1]), last]
    mean = sum(x) / n
    w = min(1.0, sum(p * q for p, q in zip(a, x, strict=True)) ** 2 / sum((v - mean) ** 2 for v in x))
    return w, _shapiro_p(w, n)


def _shapiro_p(w: float, n: int) -> float:
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1:
        return 1.0
    if n <= 11:
        y = -math.log(_poly([-2.273, 0.459], n) - math.log(1 - w))
        mu, sigma = _poly([0.544, -0.39978, 0.025054, -6.714e-4], n), math.exp(_poly([1.3822, -0.77857, 0.062767, -0.0020322], n))
    else:
        u, y = math.log(n), math.log(1 - w)
        mu, sigma = _poly([-1.5861, -0.31082, -0.083751, 0.0038915], u), math.exp(_poly([-0.4803, -0.082676, 0.0030302], u))
    return 1 - NORMAL.cdf((y - mu) / sigma)


def normal_scores(first: np.ndarray, count: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the sums of the normal scores, and of their squares, of ``count`` ranks of n from ``first`` on."""
    starts = np.cumsum(count) - count
    rank = np.arange(int(count.sum())) - np.repeat(starts - first, count)
    share = (rank - 0.375) / (np.repeat(n, count) + 0.25)
    scores = np.fromiter(map(NORMAL.inv_cdf, share.tolist()), dtype=float, count=len(share))
    add = lambda x: np.add.reduceat(x, starts) if len(x) else np.zeros(len(count))
    return add(scores), add(scores * scores)


def shapiro_from_sums(n: int, mx: float, mm: float, ss: float, x1: float, x2: float, y2: float, y1: float) -> tuple[float | None, float | None]:
    """W and p of ``shapiro_wilk`` from sums over n ordered values: scores times values, scores squared, squared distances from the mean, the two least and the two largest values."""
    if n < 3 or x1 == y1:
        return None, None
    score = lambda i: NORMAL.inv_cdf((i - 0.375) / (n + 0.25))
    r, m1, m2 = 1 / math.sqrt(n), score(n), score(n - 1)
    if n == 3:
        form = math.sqrt(0.5) * (y1 - x1)
    else:
        last = m1 / math.sqrt(mm) + _poly([0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056], r)
        inner, form = mx - m1 * (y1 - x1), last * (y1 - x1)
        if n > 5:
            before = m2 / math.sqrt(mm) + _poly([0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633], r)
            phi = (mm - 2 * m1**2 - 2 * m2**2) / (1 - 2 * last**2 - 2 * before**2)
            inner, form = inner - m2 * (y2 - x2), form + before * (y2 - x2)
        else:
            phi = (mm - 2 * m1**2) / (1 - 2 * last**2)
        form += inner / math.sqrt(phi)
    w = min(1.0, form**2 / ss)
    return w, _shapiro_p(w, n)


def _vector(f):
    @F.pandas_udf(DoubleType())
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v != v for v in row) else f(*row) for row in zip(*columns, strict=True)], dtype="float64")

    return run


chi2_p = _vector(lambda x, df: chi2_tail(x, int(df)))
normal_p = _vector(normal_tail)
binomial_p = _vector(lambda k, n: binomial_two_sided(int(k), int(n)))
signed_rank_p = _vector(lambda w, n, t: signed_rank_tail(w, int(n), t > 0, t))
normal_cdf = _vector(NORMAL.cdf)


@F.pandas_udf(StructType([StructField("w", DoubleType()), StructField("p", DoubleType())]))
def shapiro_of_sums(n: pd.Series, mx: pd.Series, mm: pd.Series, ss: pd.Series, x1: pd.Series, x2: pd.Series, y2: pd.Series, y1: pd.Series) -> pd.DataFrame:
    """``shapiro_from_sums`` of rows."""
    return pd.DataFrame([shapiro_from_sums(int(row[0]), *row[1:]) for row in zip(n, mx, mm, ss, x1, x2, y2, y1, strict=True)], columns=["w", "p"], dtype="float64")
