"""User-defined aggregates with a state that can be created, updated, merged and finished.

Spark's Python has no such interface: a grouped-aggregate UDF sees all values of a key in one task.
Here a task folds its own rows into one state a key (``update`` gets NumPy columns of many rows at a
time) and sends the states as bytes; states of a key are merged on the way and finished at the end.
What is shuffled is one state a key and task, so a key that holds a third of all rows costs no more
than any other, and no task ever holds the rows of a key.

States are merged in two rounds: first those of neighbouring tasks, ``FAN_IN`` at a time, then the rest,
each as a stream of which one state is held. So even a key that every one of 100,000 tasks has seen is
merged by 400 tasks of 250 states and one of 400.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator
from typing import Any, ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks whose states of a key are merged together in the first round.
FAN_IN = 256
#: Keys whose states a task holds before it sends them; a key may be sent more than once.
HELD_KEYS = 50_000
_STATE, _TASK = "_state", "_task"


class UserAggregate(ABC):
    """What to do with the values of a key. One object travels to all tasks and must not change.

    ``merge(a, b)`` must not depend on how rows were split into states; ``update`` and ``merge`` may
    change and return their first argument.
    """

    #: DDL of the result columns, in the order in which ``finish`` returns them.
    result: ClassVar[str]

    @abstractmethod
    def create(self) -> Any: ...

    @abstractmethod
    def update(self, state: Any, *columns: np.ndarray) -> Any:
        """The state with more rows in it; nulls have been left out (see ``aggregate``)."""

    @abstractmethod
    def merge(self, state: Any, other: Any) -> Any: ...

    @abstractmethod
    def finish(self, state: Any) -> tuple: ...

    @abstractmethod
    def to_bytes(self, state: Any) -> bytes: ...

    @abstractmethod
    def from_bytes(self, data: bytes) -> Any: ...


def _slices(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """Each key of a batch with the places of its rows."""
    if not keys:
        yield (), np.arange(batch.num_rows)
        return
    table = pa.table({k: batch.column(k) for k in keys}).append_column("_at", pa.array(np.arange(batch.num_rows)))
    grouped = table.group_by(keys, use_threads=False).aggregate([("_at", "list")])
    columns = [grouped.column(k).to_pylist() for k in keys]
    for row, places in enumerate(grouped.column("_at_list")):
        yield tuple(c[row] for c in columns), places.values.to_numpy()


def _partial(aggregate: UserAggregate, keys: list[str], values: list[str], schema: pa.Schema):
    def send(states: dict[tuple, Any], task: int) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in states], schema.field(i).type) for i in range(len(keys))]
        packed = pa.array([aggregate.to_bytes(s) for s in states.values()], pa.binary())
        return pa.RecordBatch.from_arrays([*columns, packed, pa.array([task] * len(states), pa.int32())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() // FAN_IN
        states: dict[tuple, Any] = {}
        for batch in batches:
            for key, places in _slices(batch, keys):
                state = states[key] if key in states else aggregate.create()
                rows = batch.take(pa.array(places)) if len(places) < batch.num_rows else batch
                whole = [rows.column(v) for v in values]
                present = None
                for column in whole:
                    if column.null_count:
                        valid = pc.is_valid(column)
                        present = valid if present is None else pc.and_(present, valid)
                if present is not None:
                    whole = [c.filter(present) for c in whole]
                states[key] = aggregate.update(state, *(c.to_numpy(zero_copy_only=False) for c in whole))
            if len(states) > HELD_KEYS:
                yield send(states, task)
                states = {}
        if states:
            yield send(states, task)

    return run


def _merged(aggregate: UserAggregate, names: list[str], last: bool, schema: pa.Schema):
    """Merge the states of a group one by one; the last round finishes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, head = None, None
        for batch in batches:
            head = batch.slice(0, 1) if head is None and batch.num_rows else head
            for data in batch.column(_STATE).to_pylist():
                other = aggregate.from_bytes(data)
                state = other if state is None else aggregate.merge(state, other)
        found = aggregate.finish(state) if last else (aggregate.to_bytes(state),)
        columns = [head.column(n) for n in names]
        columns += [pa.array([x], schema.field(len(names) + i).type) for i, x in enumerate(found)]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _arrow_schema(df: DataFrame, ddl: str) -> tuple[str, pa.Schema]:
    """The DDL with ``df``'s columns in front, and the same as Arrow fields."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    whole = StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])
    return whole, to_arrow_schema(whole)


def partial_states(df: DataFrame, keys: list[str], values: list[str], aggregate: UserAggregate) -> DataFrame:
    """(keys, _state, _task): one row a key and task, before any shuffle."""
    rows = df.select(*keys, *values)
    schema, arrow = _arrow_schema(rows.select(*keys), f"{_STATE} binary, {_TASK} int")
    return rows.mapInArrow(_partial(aggregate, keys, values, arrow), schema)


def merge_states(states: DataFrame, keys: list[str], aggregate: UserAggregate, finish: bool = True) -> DataFrame:
    """One row a key out of (keys, _state): its result, or its merged state with ``finish=False``.

    States may come from ``partial_states`` or from a table of merged states that was kept.
    """
    ddl = aggregate.result if finish else f"{_STATE} binary"
    if _TASK in states.columns:
        first, arrow = _arrow_schema(states.select(*keys, _TASK), f"{_STATE} binary")
        # A round of its own only where a key can have many states.
        states = states.groupBy(*keys, _TASK).applyInArrow(_merged(aggregate, [*keys, _TASK], False, arrow), first)
    schema, arrow = _arrow_schema(states.select(*keys), ddl)
    grouped = states.select(*keys, _STATE).groupBy(*keys)
    return grouped.applyInArrow(_merged(aggregate, keys, finish, arrow), schema)


def aggregate_by_key(df: DataFrame, keys: list[str], values: list[str], aggregate: UserAggregate) -> DataFrame:
    """(keys, result columns) for every key of ``df``; null keys are a key of their own.

    Rows with a null among ``values`` take no part, but their key comes out. No keys: one row for all
    rows, none for an empty frame. Result columns must not be named like keys.
    """
    return merge_states(partial_states(df, keys, values, aggregate), keys, aggregate)
