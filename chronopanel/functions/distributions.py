"""Normal and Student-t probabilities as Arrow functions (Spark SQL has no erf)."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_cdf_array(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(-v / math.sqrt(2.0)) if v == v else np.nan for v in x])


def beta_tail(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by the modified Lentz continued fraction, vectorised."""
    tiny = 1e-300
    log_front = np.array([math.lgamma(p + b) - math.lgamma(p) - math.lgamma(b) for p in a])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(log_front + a * np.log(x) + b * np.log1p(-x))
    swap = x > (a + 1.0) / (a + b + 2.0)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    c, d = np.ones_like(z), 1.0 - (p + q) * z / (p + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for numerator in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
                          -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1.0 + numerator * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + numerator / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h *= step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    value = front * h / p
    return np.clip(np.where(swap, 1.0 - value, value), 0.0, 1.0)


def student_sf_array(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T > t)."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    out = np.full(t.shape, np.nan)
    out[np.isposinf(t)] = 0.0
    out[np.isneginf(t)] = 1.0
    ok = np.isfinite(t) & (df > 0)
    if ok.any():
        tail = 0.5 * beta_tail(df[ok] / 2.0, 0.5, df[ok] / (df[ok] + t[ok] ** 2))
        out[ok] = np.where(t[ok] >= 0, tail, 1.0 - tail)
    return out


@F.pandas_udf(T.DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return pd.Series(normal_cdf_array(x.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def normal_ppf(p: pd.Series) -> pd.Series:
    nd = NormalDist()
    return p.map(lambda v: nd.inv_cdf(v) if 0.0 < v < 1.0 else (math.inf if v >= 1 else -math.inf)).astype(float)


@F.pandas_udf(T.DoubleType())
def student_sf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(student_sf_array(t.to_numpy(float), df.to_numpy(float)))
