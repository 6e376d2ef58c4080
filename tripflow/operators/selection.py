"""Exact rank selection without sorting or collecting a group.

``percentile`` and ``percentile_disc`` keep every distinct value of a group in one task's memory.
Here the value is an integer ordinal, and the wanted rank is narrowed digit by digit: count the
rows per leading digit (partially aggregated, so a task emits at most 2^digit_bits rows a key),
find the digit the rank falls into, then count again among that digit's rows only. Each level is
one pass and one small shuffle whose size does not depend on the number of rows, nor on how many
of them share a key or a value.

The rows are read once per level, so they must not change between passes (a random sample must be
drawn first) and, unless they come straight from a narrow table, are best written with ``settle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripflow.sources.staging import settle

DIGIT_BITS = 18

_PREFIX, _COUNT, _RANK, _BELOW, _UP_TO = "_prefix", "_count", "_rank", "_below", "_up_to"


def quantise(value: Column, decimals: int) -> Column:
    """A double as a long counting steps of 10^-decimals, rounded half away from zero.

    Null where the value is null, NaN or too large for a long.
    """
    return F.round(value * F.lit(float(10**decimals))).try_cast("long")


def dequantise(ordinal: Column, decimals: int) -> Column:
    return ordinal / F.lit(float(10**decimals))


def rank_of(fraction: float) -> Callable[[Column], Column]:
    """Nearest rank: the ``ceil(fraction * n)``-th smallest of n, at least the first."""
    return lambda total: F.greatest(F.lit(1), F.ceil(F.lit(fraction) * total)).cast("long")


def match_keys(
    df: DataFrame, chosen: DataFrame, keys: list[str], few_keys: bool, *also: Column
) -> DataFrame:
    """Join a one-row-per-key frame to the rows; null keys match each other.

    The key columns of ``chosen`` carry the suffix ``__side``. ``few_keys`` states that the number
    of keys has a fixed bound (24 hours of a day), which is what makes the broadcast safe. For
    other keys the frame is written first: then Spark knows its true size when it plans the join,
    and broadcasts or sort-merges (splitting a skewed key) accordingly, instead of shuffling all
    rows because it had to guess.
    """
    equal = [F.col(key).eqNullSafe(F.col(side_name(key))) for key in keys]
    side = F.broadcast(chosen) if few_keys else settle(chosen, "chosen")
    return df.join(side, [*equal, *also], "inner")


def side_name(key: str) -> str:
    return f"{key}__side"


def side_keys(keys: list[str]) -> list[Column]:
    return [F.col(key).alias(side_name(key)) for key in keys]


def select_rank(
    df: DataFrame,
    keys: list[str],
    ordinal: str,
    wanted: Callable[[Column], Column],
    bits: int,
    totals: dict[str, Column] | None = None,
    few_keys: bool = False,
    digit_bits: int = DIGIT_BITS,
) -> DataFrame:
    """One row per key: the ordinal at the wanted rank among the key's rows.

    ``wanted`` turns the row count of a key into a 1-based rank; ordinals lie within
    ``-2^bits .. 2^bits``; ``totals`` are extra sums per key taken along in the first pass.
    Result: keys, ``rows``, the totals, ``ordinal``, ``below`` (rows with a smaller ordinal),
    ``at`` (rows with this ordinal) and ``rank``. Rows without an ordinal are not ranked or
    counted; a key that has no others does not come out.
    """
    totals = totals or {}
    carried = ["rows", *totals, _RANK]
    per_key = Window.partitionBy(*keys)
    running = per_key.orderBy(_PREFIX).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up_to = F.sum(_COUNT).over(running)
    shift = max(0, bits - digit_bits)

    rows = F.sum(_COUNT).over(per_key)
    ranked = (
        df.groupBy(*keys, F.shiftright(ordinal, shift).alias(_PREFIX))
        .agg(
            F.count(ordinal).alias(_COUNT),
            *[total.alias(name) for name, total in totals.items()],
        )
        .select(
            *keys,
            _PREFIX,
            _COUNT,
            rows.alias("rows"),
            *[F.sum(name).over(per_key).alias(name) for name in totals],
            wanted(rows).alias(_RANK),
            up_to.alias(_UP_TO),
        )
    )
    while True:
        # Keep the one digit per key that the rank falls into.
        chosen = ranked.where(
            (F.col(_UP_TO) - F.col(_COUNT) < F.col(_RANK)) & (F.col(_UP_TO) >= F.col(_RANK))
        )
        below = F.col(_UP_TO) - F.col(_COUNT)
        if shift == 0:
            return chosen.select(
                *keys,
                "rows",
                *totals,
                F.col(_PREFIX).alias("ordinal"),
                below.alias("below"),
                F.col(_COUNT).alias("at"),
                F.col(_RANK).alias("rank"),
            )
        digit = F.shiftright(ordinal, shift) == F.col(_PREFIX)
        shift = max(0, shift - digit_bits)
        ranked = (
            match_keys(
                df.select(*keys, ordinal),
                chosen.select(*side_keys(keys), *carried, _PREFIX, below.alias(_BELOW)),
                keys,
                few_keys,
                digit,
            )
            .groupBy(*keys, *carried, _BELOW, F.shiftright(ordinal, shift).alias(_PREFIX))
            .agg(F.count("*").alias(_COUNT))
            .select(
                *keys, *carried, _PREFIX, _COUNT, (F.col(_BELOW) + up_to).alias(_UP_TO)
            )
        )


def nearest_rank(
    df: DataFrame,
    keys: list[str],
    value: str,
    fraction: float,
    decimals: int,
    bits: int,
    totals: dict[str, Column] | None = None,
    few_keys: bool = False,
    name: str = "percentile",
) -> DataFrame:
    """Exact nearest-rank percentile per key of a measure rounded to ``decimals`` digits.

    Rows whose measure is null, NaN or too large for a long take no part, in no count either.
    """
    others = [c for c in df.columns if c != value]
    rows = df.select(*others, quantise(F.col(value), decimals).alias("_ordinal"))
    rows = rows.where(F.col("_ordinal").isNotNull())
    chosen = select_rank(rows, keys, "_ordinal", rank_of(fraction), bits, totals, few_keys)
    return chosen.select(
        *keys, "rows", *(totals or {}), dequantise(F.col("ordinal"), decimals).alias(name)
    )


def nearest_rank_of_tally(
    tally: DataFrame, keys: list[str], ordinal: str, count: str, fraction: float
) -> DataFrame:
    """Nearest rank over already counted values, for tallies of bounded length per key."""
    per_key = Window.partitionBy(*keys)
    running = per_key.orderBy(ordinal).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rank = rank_of(fraction)(F.col("_total"))
    return (
        tally.withColumn("_total", F.sum(count).over(per_key))
        .withColumn("_running", F.sum(count).over(running))
        .where((F.col("_running") >= rank) & (F.col("_running") - F.col(count) < rank))
        .select(*keys, F.col("_total").alias("rows"), F.col(ordinal).alias("ordinal"))
    )
