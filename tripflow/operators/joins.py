"""Joins of trips, or of aggregates of trips, to small dimensions and to each other.

By default the physical strategy is left to Spark: it broadcasts below
``spark.sql.autoBroadcastJoinThreshold`` (its own size check, repeated at run time by adaptive
execution) and sort-merges above. A forced broadcast goes through ``broadcast_if_small``.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def broadcast_if_small(
    df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES
) -> DataFrame:
    """Mark for broadcast after measuring rows and bytes; return unmarked when it is too large.

    The measurement is a count and a sum with partial aggregation: every task sends one row. It
    reads the whole frame, a dimension, while the plan is built.
    """
    width = reduce(add, [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 8
                         for c in df.columns])
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


def apply_strategy(dimension: DataFrame, strategy: str) -> DataFrame:
    """``auto`` leaves the choice to Spark, ``broadcast`` is size-checked, ``merge`` sort-merges."""
    if strategy == "auto":
        return dimension
    if strategy == "broadcast":
        return broadcast_if_small(dimension)
    if strategy == "merge":
        return dimension.hint("merge")
    raise ValueError(f"unknown join strategy {strategy!r}")


def lookup(
    fact: DataFrame,
    dimension: DataFrame,
    fact_key: str,
    dimension_key: str = "location_id",
    take: dict[str, str] | None = None,
    how: str = "inner",
    strategy: str = "auto",
) -> DataFrame:
    """Add dimension attributes to a fact: ``take`` maps attribute to its name in the result.

    The key is renamed before the join, so one dimension can be looked up in several roles.
    """
    take = take or {c: c for c in dimension.columns if c != dimension_key}
    side = dimension.select(
        F.col(dimension_key).alias(fact_key), *[F.col(a).alias(b) for a, b in take.items()]
    )
    return fact.join(apply_strategy(side, strategy), fact_key, how)


def on_calendar(trips: DataFrame, calendar: DataFrame, wanted: Column, day: str = "pickup_date") -> DataFrame:
    """Trips of the days that the calendar's condition picks, with the calendar's columns.

    ``trips`` are laid out by ``day``. The condition is on the calendar alone, so which folders are wanted
    is known only when the query runs: Spark evaluates the calendar first and opens those folders
    (dynamic partition pruning). A calendar has a row a day; it is broadcast after a check of its size.
    """
    return trips.join(broadcast_if_small(calendar.where(wanted)), day)


def full_outer_merge(
    left: DataFrame, right: DataFrame, keys: list[str], counts: list[str]
) -> DataFrame:
    """Full join of two aggregates; counts missing on one side become 0.

    Plain equality: a null key matches nothing, so it stays a row of its own from either side.
    """
    merged = left.join(right, keys, "full")
    return merged.select(
        *keys, *[F.coalesce(F.col(name), F.lit(0).cast("long")).alias(name) for name in counts]
    )
