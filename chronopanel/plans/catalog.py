"""Registry of queries. A query declares its result columns once; both engines project to them.

Column marks: ``~x`` double (rounded to the declared digits), ``#x`` bigint, plain ``x`` unchanged.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .oracle_parts import with_parts


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    columns: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    body: str | None
    parts: tuple[str, ...]

    @property
    def sql(self) -> str | None:
        return None if self.body is None else with_parts(list(self.parts), self.body)


CATALOG: dict[str, Query] = {}


def _project(df: DataFrame, columns: tuple[str, ...], digits: int) -> DataFrame:
    out = []
    for mark in columns:
        if mark[0] == "~":
            out.append((F.round(F.col(mark[1:]).cast("double"), digits) + F.lit(0.0)).alias(mark[1:]))
        elif mark[0] == "#":
            out.append(F.col(mark[1:]).cast("bigint").alias(mark[1:]))
        else:
            out.append(F.col(mark))
    return df.select(*out)


def _project_sql(body: str, columns: tuple[str, ...], digits: int) -> str:
    out = []
    for mark in columns:
        if mark[0] == "~":
            out.append(f'round(CAST("{mark[1:]}" AS DOUBLE), {digits}) + 0.0 AS "{mark[1:]}"')
        elif mark[0] == "#":
            out.append(f'CAST("{mark[1:]}" AS BIGINT) AS "{mark[1:]}"')
        else:
            out.append(f'"{mark}"')
    return f"SELECT {', '.join(out)} FROM (\n{body}\n) AS answer"


def query(ids: str, columns: str, sql: str | None = None, parts: str = "", digits: int = 6, name: str | None = None):
    """Register ``fn(spark, sf_dir)`` under its own name."""
    marks = tuple(columns.split())

    def register(fn):
        key = name or fn.__name__
        if key in CATALOG:
            raise ValueError(f"duplicate query {key}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return _project(fn(spark, sf_dir), marks, digits)

        text = None
        if sql is not None:
            text = _project_sql(sql.strip().rstrip(";"), marks, digits)
        CATALOG[key] = Query(key, tuple(ids.split()), marks, run, text, tuple(parts.split()))
        return fn

    return register
