"""Tail probabilities that SQL lacks, as Arrow functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _normal(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or math.isnan(v) else math.erfc(abs(v) / math.sqrt(2)))


def _upper_normal(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or math.isnan(v) else math.erfc(v / math.sqrt(2)) / 2)


def _signed_rank(w: pd.Series, n: pd.Series) -> pd.Series:
    """P(rank sum of at least w) when each of the ranks 1 to n counts with probability 1/2; the counts of sums build up rank by rank."""
    known: dict[int, np.ndarray] = {}

    def tails(n: int) -> np.ndarray:
        if n not in known:
            ways = np.ones(1)
            for r in range(1, n + 1):
                ways = (np.pad(ways, (0, r)) + np.pad(ways, (r, 0))) / 2
            known[n] = np.cumsum(ways[::-1])[::-1]
        return known[n]

    return pd.Series([None if pd.isna(a) or pd.isna(m) or m > 50 else float(tails(int(m))[math.ceil(a)]) for a, m in zip(w, n, strict=True)], dtype="float64")


def _rank_sum(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """P(at least u of the n1 * n2 pairs are in order) when all orders of the rows are alike, without ties.

    The counts are the coefficients of a Gaussian binomial: a product of (1 - q^(n + i)) / (1 - q^i), in whole numbers.
    """
    known: dict[tuple[int, int], np.ndarray] = {}

    def tails(m: int, n: int) -> np.ndarray:
        m, n = min(m, n), max(m, n)
        if (m, n) not in known:
            ways = np.zeros(m * n + 1, dtype=object)
            ways[0] = 1
            for i in range(1, m + 1):
                if n + i <= m * n:
                    ways[n + i :] = ways[n + i :] - ways[: m * n + 1 - n - i]
                for r in range(min(i, m * n + 1)):
                    ways[r::i] = np.add.accumulate(ways[r::i])
            upper, whole = np.add.accumulate(ways[::-1])[::-1], sum(ways)
            known[m, n] = np.array([x / whole for x in upper])
        return known[m, n]

    return pd.Series([None if pd.isna(a) else float(tails(int(x), int(y))[max(0, math.ceil(a))]) for a, x, y in zip(u, n1, n2, strict=True)], dtype="float64")


def _hypergeometric(k: pd.Series, drawn: pd.Series, good: pd.Series, total: pd.Series) -> pd.Series:
    choose = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)

    def tail(k: int, n: int, g: int, t: int) -> float:
        at = np.arange(k, min(n, g) + 1)
        at = at[n - at <= t - g]
        return float(min(1.0, sum(math.exp(choose(g, int(i)) + choose(t - g, n - int(i)) - choose(t, n)) for i in at)))

    return pd.Series([tail(int(a), int(b), int(c), int(d)) for a, b, c, d in zip(k, drawn, good, total, strict=True)])


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * h


def _student(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(n) or n <= 0 else _beta(n / 2, 0.5, n / (n + a * a)) for a, n in zip(t, df, strict=True)], dtype="float64")


def normal_two_sided(z: Column | str) -> Column:
    return F.pandas_udf(_normal, "double")(z)


def normal_sf(z: Column | str) -> Column:
    return F.pandas_udf(_upper_normal, "double")(z)


def signed_rank_sf(w: Column | str, n: Column | str) -> Column:
    """Exact upper tail of the signed-rank sum of up to 50 differences; null for more."""
    return F.pandas_udf(_signed_rank, "double")(w, n)


def rank_sum_sf(u: Column | str, n1: Column | str, n2: Column | str) -> Column:
    """Exact upper tail of the rank-sum statistic without ties; null where u is."""
    return F.pandas_udf(_rank_sum, "double")(u, n1, n2)


def hypergeometric_sf(k: Column | str, drawn: Column | str, good: Column | str, total: Column | str) -> Column:
    """P(at least k good ones among the drawn)."""
    return F.pandas_udf(_hypergeometric, "double")(k, drawn, good, total)


def t_two_sided(t: Column | str, df: Column | str) -> Column:
    return F.pandas_udf(_student, "double")(t, df)
