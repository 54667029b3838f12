"""Exact statistics: bounds on rates and the chance of a pattern under random labels."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, confidence: float = 0.95, upper: bool = True) -> Column:
    """One-sided Wilson bound of a rate, rounded outwards at 12 places; null without trials."""
    z = NormalDist().inv_cdf(confidence)
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n
    middle, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    bound = (middle + spread if upper else middle - spread) / (1 + z * z / n)
    whole = F.ceil(bound * 1e12) if upper else F.floor(bound * 1e12)
    return F.when(n.isNotNull(), F.least(F.greatest(whole / 1e12, F.lit(0.0)), F.lit(1.0)))


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """Chance of at most k of n."""
    if k < 0:
        return 0.0
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    a, b = math.log(p), math.log1p(-p)
    return min(1.0, math.fsum(math.exp(_log_choose(n, i) + i * a + (n - i) * b) for i in range(k + 1)))


def upper_rate(k: int, n: int, confidence: float = 0.95) -> float:
    """One-sided Clopper-Pearson upper bound, by halving."""
    if n <= 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if binomial_cdf(k, n, middle) > 1 - confidence else (low, middle)
    return high


def clopper_pearson(k: Column, n: Column, confidence: float = 0.95) -> Column:
    """One-sided Clopper-Pearson upper bound of a rate; Spark has no inverse of the binomial."""

    @F.pandas_udf("double")
    def bound(ks: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([upper_rate(int(a), int(b), confidence) for a, b in zip(ks, ns)], dtype="float64")

    return bound(k, n)


def all_hold(n: Column, holds: Column, k: Column) -> Column:
    """Chance that k cases drawn from n, of which ``holds`` are held, are all held."""
    steps = F.when(k > 0, F.sequence(F.lit(0), (k - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(1.0), lambda p, i: p * (holds - i) / (n - i))


def zero_miss_size(bar: Column, confidence: float = 0.95) -> Column:
    """The fewest cases, all clean, whose exact upper bound on the error rate is at or below ``bar``."""
    n = F.ceil(F.log(F.lit(1 - confidence)) / F.log(1 - bar) - 1e-9)
    return F.when((bar > 0) & (bar < 1), F.greatest(n, F.lit(1))).cast("long")


def caught_rate(caught: Column, n: Column, confidence: float = 0.95) -> Column:
    """Lower bound of the share caught: one less the upper bound of the share missed."""
    return 1 - wilson(n - caught, n, confidence)
