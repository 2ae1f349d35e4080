"""Quantiles of the usual distributions, from the JVM's mathematics library (no data is involved)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _distribution(spark: SparkSession, name: str, *parameters: float):
    return getattr(spark._jvm.org.apache.commons.math3.distribution, name)(*map(float, parameters))


def f(spark: SparkSession, p: float, d1: float, d2: float) -> float:
    return _distribution(spark, "FDistribution", d1, d2).inverseCumulativeProbability(p)


def f_tail(spark: SparkSession, value: float, d1: float, d2: float) -> float:
    return 1 - _distribution(spark, "FDistribution", d1, d2).cumulativeProbability(float(value))


def chi2(spark: SparkSession, p: float, df: float) -> float:
    return _distribution(spark, "ChiSquaredDistribution", df).inverseCumulativeProbability(p)


def gamma_below(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised lower incomplete gamma function: its series left of a + 1, a continued fraction right of it."""
    a, x = np.asarray(a, float), np.asarray(x, float)
    out = np.where(x > 0, np.nan, 0.0)
    # e^-x x^a / gamma(a)
    scale = np.exp(-x + a * np.log(np.where(x > 0, x, 1.0)) - np.array([math.lgamma(v) for v in a]))
    on = (x > 0) & (x < a + 1)
    if on.any():
        n, v = a[on].copy(), x[on]
        term = 1 / n
        total = term.copy()
        while (term > 1e-17 * total).any():
            n += 1
            term = term * v / n
            total += term
        out[on] = total * scale[on]
    on = x >= a + 1
    if on.any():
        v, own = x[on], a[on]
        b = v + 1 - own
        c, d = np.full(len(v), 1e300), 1 / b
        h = d.copy()
        for i in range(1, 100_000):
            k = i * (own - i)
            b = b + 2
            d = 1 / np.where(np.abs(b + k * d) < 1e-300, 1e-300, b + k * d)
            c = b + k / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            h = h * c * d
            if (np.abs(c * d - 1) < 1e-15).all():
                break
        out[on] = 1 - h * scale[on]
    return out


def chi2_below(value: Column, df: Column) -> Column:
    """The share of the chi-squared distribution under a value, by row; null for null."""

    @F.pandas_udf("double")
    def below(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for v, k in batches:
            known = (v.notna() & k.notna()).to_numpy()
            out = np.full(len(v), np.nan)
            out[known] = gamma_below(k[known].to_numpy() / 2, v[known].to_numpy() / 2)
            yield pd.Series(pd.array(out, "Float64"))

    return below(value, df)


def t_two_sided(spark: SparkSession, value: float, df: float) -> float:
    return 2 * (1 - _distribution(spark, "TDistribution", df).cumulativeProbability(abs(float(value))))


def normal(spark: SparkSession, p: float) -> float:
    return _distribution(spark, "NormalDistribution").inverseCumulativeProbability(p)


def normal_cdf(spark: SparkSession, value: float) -> float:
    return _distribution(spark, "NormalDistribution").cumulativeProbability(float(value))


def hotelling_limit(spark: SparkSession, n: int, k: int, alpha: float = 0.05) -> float:
    """k (n - 1)(n + 1) / (n (n - k)) F(1 - alpha; k, n - k); infinite if n <= k."""
    return float("inf") if n <= k else k * (n - 1) * (n + 1) / (n * (n - k)) * f(spark, 1 - alpha, k, n - k)
