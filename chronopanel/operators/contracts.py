"""User features as DataFrame functions with declared inputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Feature:
    name: str
    needs: tuple[str, ...]
    lookback: int
    build: Callable[[DataFrame], DataFrame]


class FeatureRegistry:
    """Named features; applying several keeps one lineage, so equal window partitionings share a shuffle."""

    def __init__(self):
        self._features: dict[str, Feature] = {}

    def add(self, name: str, needs: tuple[str, ...], lookback: int, build: Callable[[DataFrame], DataFrame]) -> None:
        if name in self._features:
            raise ValueError(f"feature {name} exists")
        self._features[name] = Feature(name, needs, lookback, build)

    def apply(self, df: DataFrame, names: list[str]) -> DataFrame:
        for name in names:
            f = self._features[name]
            lost = set(f.needs) - set(df.columns)
            if lost:
                raise ValueError(f"{name} needs {sorted(lost)}")
            df = df.transform(f.build)
            if name not in df.columns:
                raise ValueError(f"{name} did not build its column")
        return df
