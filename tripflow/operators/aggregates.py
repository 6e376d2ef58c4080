"""Grouped means and shares, and the shapes they are combined in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripflow.sources.staging import settle


def share_where(condition: Column) -> Column:
    """Share of rows meeting a condition; a null condition counts as not met."""
    return F.avg(F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0)))


def avg_where(condition: Column, value: Column) -> Column:
    """Mean over the rows meeting a condition; null if there are none."""
    return F.avg(F.when(condition, value))


def two_level_mean(
    df: DataFrame, keys: list[str], inner: Column, value: str, alias: str = "mean"
) -> DataFrame:
    """Mean per key through a finer grouping first, merged as (sum, count).

    Spark's own partial aggregation already does this for ``avg``; the explicit form is for a key
    so hot that even its partial results should be merged in two steps, or for keeping the finer
    level.
    """
    fine = df.groupBy(*keys, inner.alias("_inner")).agg(
        F.sum(value).alias("_sum"), F.count(value).alias("_count")
    )
    return fine.groupBy(*keys).agg(
        F.sum("_count").alias("rows"),
        F.try_divide(F.sum("_sum"), F.sum("_count")).alias(alias),
    )


def mean_by_join(df: DataFrame, keys: list[str], value: str, alias: str = "mean") -> DataFrame:
    """Counts joined to sums, null keys to null keys. Both come from one scan's partial sums.

    One ``groupBy`` would do; this is the shape of a join of aggregates that are kept apart.
    """
    both = settle(
        df.groupBy(*keys).agg(F.count(value).alias("rows"), F.sum(value).alias("_sum")), "sums"
    )
    counts = both.select(*keys, "rows").alias("c")
    sums = both.select(*keys, "_sum").alias("s")
    same = [F.col(f"c.{key}").eqNullSafe(F.col(f"s.{key}")) for key in keys]
    mean = F.try_divide(F.col("_sum"), F.col("rows")).alias(alias)
    return counts.join(sums, same).select(*[F.col(f"c.{key}") for key in keys], "rows", mean)
