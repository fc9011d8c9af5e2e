"""Keyed state: refusal of retroactive marks and the recommendation state machine.

On a live feed the state of a key ends a month after its last change; a replay of a finished folder keeps it to the
end, for a run that only drains what is there never comes to rest while it waits for state to expire. Rows of a key are read in arrival order; a feed that does not keep
that order between batches goes through `runs.drain_in_order`.

A state processor costs milliseconds a key, which a live feed with few changes a batch does not feel. A replay has every
key in every batch: there a `Fold` takes the same steps over rows sorted by key, with the states of the batch before
among them, and no call for each key.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

MONTH_MS = 31 * 24 * 3600 * 1000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Allowed state changes.
ALLOWED = {
    "PROPOSED": ("WAITING", "CONFIRMED", "CANCELLED"),
    "WAITING": ("CONFIRMED", "UPDATED", "CANCELLED"),
    "UPDATED": ("WAITING", "CONFIRMED", "CANCELLED"),
    "CONFIRMED": ("UPDATED", "CANCELLED", "ENTERED"),
    "ENTERED": ("EXITED",),
}


class MarkGate(StatefulProcessor):
    """Accept a mark only when it is later than the latest accepted one; keep running extremes."""

    def __init__(self, live: bool = False):
        self.ttl = MONTH_MS if live else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at timestamp, low double, high double", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        state = self.last.get() if self.last.exists() else None
        at, low, high = state if state else (None, None, None)
        out = []
        for row in pd.concat(list(rows)).sort_values("arrival").itertuples():
            fine = at is None or row.at > pd.Timestamp(at)
            if fine:
                at = row.at.to_pydatetime()
                low = row.price if low is None else min(low, row.price)
                high = row.price if high is None else max(high, row.price)
            out.append((key[0], row.event_id, fine, low, high))
        self.last.update((at, low, high))
        yield pd.DataFrame(out, columns=["recommendation_id", "event_id", "accepted", "low", "high"])

    def close(self) -> None:
        pass


class Transitions(StatefulProcessor):
    """Apply allowed state changes in arrival order; each adds one revision. A change that is not allowed, or that
    expects another revision than the present one, is refused (no expectation: any revision will do)."""

    def __init__(self, live: bool = False):
        self.ttl = MONTH_MS if live else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "state string, revision int", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        state, revision = self.now.get() if self.now.exists() else ("PROPOSED", 0)
        out = []
        for row in pd.concat(list(rows)).sort_values("event_id").itertuples():
            moved = row.to_state in ALLOWED.get(state, ()) and (pd.isna(row.expected) or int(row.expected) == revision)
            if moved:
                state, revision = row.to_state, revision + 1
            out.append((key[0], row.event_id, row.to_state, moved, state, revision))
        self.now.update((state, revision))
        yield pd.DataFrame(out, columns=["recommendation_id", "event_id", "to_state", "accepted", "state", "revision"])

    def close(self) -> None:
        pass


def _run(rows: DataFrame, processor: StatefulProcessor, schema: str, live: bool) -> DataFrame:
    """Needs the RocksDB state store: a session that has named no other gets it. The processor travels by value, for
    the process that sets it up has no files that were added to the application."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    conf = rows.sparkSession.conf
    if conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return rows.groupBy("recommendation_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if live else "None")


def gated_marks(marks: DataFrame, live: bool = False) -> DataFrame:
    return _run(marks, MarkGate(live), "recommendation_id string, event_id bigint, accepted boolean, low double, high double", live)


def transitions(changes: DataFrame, live: bool = False) -> DataFrame:
    return _run(changes, Transitions(live), "recommendation_id string, event_id bigint, to_state string, accepted boolean, state string, revision int", live)


KEY = "recommendation_id"


class Fold(NamedTuple):
    """Steps over the rows of a key in their order. `step(state, *items)` gives the next state and the answer."""

    order: str
    items: dict[str, str]  # name -> expression over the rows
    state: str
    start: tuple
    answer: str
    step: Callable


def _mark(state: tuple, event_id, at, price) -> tuple[tuple, tuple]:
    last, low, high = state
    fine = last is None or at is None or at > last
    if fine:
        last = last if at is None else at
        if price is not None:
            low = price if low is None else min(low, price)
            high = price if high is None else max(high, price)
    return (last, low, high), (event_id, fine, low, high)


def _change(state: tuple, event_id, to_state, expected) -> tuple[tuple, tuple]:
    now, revision = state
    moved = to_state in ALLOWED.get(now, ()) and (expected is None or expected == revision)
    if moved:
        now, revision = to_state, revision + 1
    return (now, revision), (event_id, to_state, moved, now, revision)


MARKS = Fold("arrival", {"event_id": "event_id", "at": "unix_micros(at)", "price": "price"}, "now_at bigint, now_low double, now_high double", (None, None, None),
             "event_id bigint, accepted boolean, low double, high double", _mark)
CHANGES = Fold("event_id", {"event_id": "event_id", "to_state": "to_state", "expected": "expected"}, "now_state string, now_revision int", ("PROPOSED", 0),
               "event_id bigint, to_state string, accepted boolean, state string, revision int", _change)


def folded_schema(fold: Fold) -> T.StructType:
    """Answers (not held) and the states that the batch leaves (held)."""
    return T.StructType.fromDDL(f"{KEY} string, {fold.answer}, {fold.state}, held boolean")


def folded(batch: DataFrame, before: DataFrame | None, fold: Fold) -> DataFrame:
    """One batch of rows with the states `before` it. Rows stream through a task sorted by key, so a key of any size
    takes one state and one Arrow batch of memory."""
    states, schema = T.StructType.fromDDL(fold.state), folded_schema(fold)
    rows = batch.select(KEY, F.lit(False).alias("held"), F.col(fold.order).alias("_order"), *[F.expr(e).alias(f"_i_{n}") for n, e in fold.items.items()],
                        *[F.lit(None).cast(f.dataType).alias(f.name) for f in states])
    if before is not None:
        rows = rows.unionByName(before.select(KEY, F.lit(True).alias("held"), *states.names), allowMissingColumns=True)
    n_items, n_states, start, step = len(fold.items), len(states), fold.start, fold.step
    n_answer = len(schema) - n_states - 2
    kinds = [pa.string(), *[_ARROW[f.dataType.simpleString()] for f in schema.fields[1:]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], schema.names)

        no_answer, no_state, key, now = (None,) * n_answer, (None,) * n_states, None, None
        for held in batches:
            out = []
            for one, is_state, _, *values in zip(*[c.to_pylist() for c in held.columns], strict=True):
                if now is None or one != key:
                    if now is not None:
                        out.append((key, *no_answer, *now, True))
                    key, now = one, start
                if is_state:
                    now = tuple(values[n_items:])
                else:
                    now, answer = step(now, *values[:n_items])
                    out.append((key, *answer, *no_state, False))
            yield packed(out)
        if now is not None:
            yield packed([(key, *no_answer, *now, True)])

    return rows.repartition(KEY).sortWithinPartitions(KEY, F.desc("held"), F.asc_nulls_last("_order")).mapInArrow(run, schema)


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
