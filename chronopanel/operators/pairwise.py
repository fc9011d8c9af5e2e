"""Pairwise statistics as blocked matrix products.

Keys are hashed to blocks; one Arrow group is a pair of blocks over the whole calendar, so a task holds
two (sessions x block) matrices however many keys exist. Each block meets each block once and only rows
that pass the caller's filter leave the task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 256


def block_count(df: DataFrame, key: str, size: int = BLOCK) -> int:
    return max(1, -(-df.agg(F.approx_count_distinct(key)).first()[0] // size))


def pair_moments(df: DataFrame, groups: list[str], key: str, order: str, value: str, blocks: int, keep,
                 columns: str) -> DataFrame:
    """Apply ``keep(n, sx, sy, sxx, syy, sxy)`` (pairwise-complete sums) to every unordered key pair."""
    tag = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    base = df.where(F.col(value).isNotNull()).select(*groups, key, F.col(order).alias("_o"), F.col(value).cast("double").alias("_v"), tag.alias("_b"))
    others = F.array(*[F.lit(i) for i in range(blocks)])
    spread = base.select("*", F.explode(others).alias("_c")).select(
        *groups, key, "_o", "_v", "_b", F.least("_b", "_c").alias("_i"), F.greatest("_b", "_c").alias("_j"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["_i"].iloc[0]), int(pdf["_j"].iloc[0])
        wide = pdf.pivot(index="_o", columns=key, values="_v")
        side = pdf.groupby(key)["_b"].first()
        left = [k for k in wide.columns if side[k] == i]
        right = [k for k in wide.columns if side[k] == j]
        x, y = wide[left].to_numpy(float), wide[right].to_numpy(float)
        mx, my = ~np.isnan(x), ~np.isnan(y)
        x0, y0 = np.where(mx, x, 0.0), np.where(my, y, 0.0)
        fx, fy = mx.astype(float), my.astype(float)
        sums = (fx.T @ fy, x0.T @ fy, fx.T @ y0, (x0 * x0).T @ fy, fx.T @ (y0 * y0), x0.T @ y0)
        names = np.array(left, dtype=object)[:, None], np.array(right, dtype=object)[None, :]
        once = names[0] < names[1] if i == j else np.ones(sums[0].shape, dtype=bool)
        rows, cols = np.nonzero(once & (sums[0] > 0))
        a, b = np.array(left, dtype=object)[rows], np.array(right, dtype=object)[cols]
        flip = a > b
        n, sx, sy, sxx, syy, sxy = (s[rows, cols] for s in sums)
        out = keep(n, np.where(flip, sy, sx), np.where(flip, sx, sy), np.where(flip, syy, sxx), np.where(flip, sxx, syy), sxy)
        out.insert(0, "b", np.where(flip, a, b))
        out.insert(0, "a", np.where(flip, b, a))
        for g in groups:
            out[g] = pdf[g].iloc[0]
        return out[out["_ok"]].drop(columns="_ok")

    head = "".join(f", {g} {df.schema[g].dataType.simpleString()}" for g in groups)
    return spread.groupBy(*groups, "_i", "_j").applyInPandas(run, f"a string, b string, {columns}{head}")


def closest(df: DataFrame, groups: list[str], key: str, order: str, value: str, k: int, minimum: int) -> DataFrame:
    """k pairs per group with the smallest sum of squared differences."""

    def keep(n, sx, sy, sxx, syy, sxy):
        ssd = np.maximum(sxx + syy - 2.0 * sxy, 0.0)
        mean = (sx - sy) / n
        var = np.maximum(ssd - n * mean * mean, 0.0) / np.maximum(n - 1.0, 1.0)
        return pd.DataFrame({"n": n, "ssd": ssd, "sd": np.sqrt(var), "_ok": n >= minimum})

    x = pair_moments(df, groups, key, order, value, block_count(df, key), keep, "n double, ssd double, sd double")
    w = W.partitionBy(*groups).orderBy(F.round("ssd", 6), "a", "b")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def correlated(df: DataFrame, key: str, order: str, value: str, threshold: float, minimum: int = 20) -> DataFrame:
    """Edges between keys whose absolute correlation over common rows reaches the threshold."""

    def keep(n, sx, sy, sxx, syy, sxy):
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        with np.errstate(divide="ignore", invalid="ignore"):
            r = (sxy - sx * sy / n) / np.sqrt(vx * vy)
        return pd.DataFrame({"n": n, "corr": r, "_ok": (n >= minimum) & (np.abs(r) >= threshold)})

    return pair_moments(df, [], key, order, value, block_count(df, key), keep, "n double, corr double")
