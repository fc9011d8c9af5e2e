"""Folds over the ordered rows of a key, inside the JVM.

`fold` is for recursions that no frame can say: it gathers a key's rows in order, carries a struct from row to row and
returns one struct a row. A key must be bounded by the calendar (one symbol, one pair in one cycle, one trial).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(df: DataFrame, keys: list[str], order: str, columns: list[str], start: dict[str, Column], step: Callable, emit: Callable, types: str) -> DataFrame:
    """One output row (keys, order, fields of `types`) for each input row.

    ``step(state, row)`` gives the next state as a dict over the names of ``start``; ``emit(before, after, row)`` gives
    the output fields as a dict in the order of ``types``.
    """
    rows = F.array_sort(F.collect_list(F.struct(order, *columns)))
    held = df.groupBy(*keys).agg(rows.alias("rows"))
    kind = dict(held.dtypes)["rows"].removeprefix("array<").removesuffix(">")
    place = kind.removeprefix("struct<").split(",")[0].split(":")[1]
    out = f"array<struct<{order}:{place},{types}>>"
    zero = F.struct(*[c.alias(n) for n, c in start.items()], F.from_json(F.lit("[]"), out).alias("out"))

    def merge(state, row):
        after = step(state, row)
        made = emit(state, after, row)
        piece = F.array(F.struct(row[order].alias(order), *[c.alias(n) for n, c in made.items()]))
        return F.struct(*[after[n].alias(n) for n in start], F.concat(state["out"], piece).alias("out"))

    return held.select(*keys, F.inline(F.aggregate("rows", zero, merge, lambda s: s["out"])))
