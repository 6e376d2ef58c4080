"""Table functions: one key in, many rows out, for SQL text.

``register_table_functions`` gives them their SQL names. The first two take a whole table as argument,
which the caller partitions and orders: ``f(TABLE(t) PARTITION BY key ORDER BY x)``. Each key is read as
a stream by one instance, which holds no rows; Spark shuffles and sorts. A key's rows go to one task, so
tables are aggregated (by day, say) before they are handed over. The third takes values and stands in a
lateral join, without any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


@udtf
class BestRows:
    """best_rows(TABLE(t) PARTITION BY .. ORDER BY .., k): the first k rows of a key, with their place."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, k: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(schema=StructType([*rows.dataType.fields]).add("place", IntegerType()))

    def __init__(self) -> None:
        self.seen = 0

    def eval(self, rows: Row, k: int) -> Iterator[tuple]:
        self.seen += 1
        if self.seen <= k:
            yield (*rows, self.seen)


@udtf
class RisingRuns:
    """rising_runs(TABLE(t) PARTITION BY key ORDER BY at): maximal runs of rows whose value rises.

    The table's columns are key, at and value, by position. A row comes out for every run: key, first and
    last at, number of rows, and what the value gained. A null or an equal value ends a run; nulls are in
    none.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        key, at, value = rows.dataType.fields
        schema = StructType().add(key.name, key.dataType).add("start", at.dataType).add("stop", at.dataType)
        return AnalyzeResult(schema=schema.add("length", LongType()).add("gain", value.dataType))

    def __init__(self) -> None:
        self.run: list | None = None  # key, start, stop, length, first value, last value

    def _end(self) -> Iterator[tuple]:
        if self.run is not None:
            key, start, stop, length, first, last = self.run
            yield key, start, stop, length, last - first
        self.run = None

    def eval(self, rows: Row) -> Iterator[tuple]:
        key, at, value = rows
        if value is None or self.run is None or value <= self.run[5]:
            yield from self._end()
            self.run = None if value is None else [key, at, at, 1, value, value]
        else:
            self.run[2:] = [at, self.run[3] + 1, self.run[4], value]

    def terminate(self) -> Iterator[tuple]:
        yield from self._end()


@udtf(returnType=StructType().add("hour", IntegerType()).add("day_shift", IntegerType()))
class WindowHours:
    """window_hours(start, count): the hours of a window, and whether they are of the next day."""

    def eval(self, start: int, count: int) -> Iterator[tuple]:
        if start is not None and count is not None:
            for hour in range(start, start + min(count, 24)):
                yield hour % 24, hour // 24


def register_table_functions(spark: SparkSession) -> None:
    """Make the functions known to SQL text of this session, under their names in snake case."""
    for name, function in (("best_rows", BestRows), ("rising_runs", RisingRuns), ("window_hours", WindowHours)):
        spark.udtf.register(name, function)
