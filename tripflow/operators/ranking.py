"""Top-K per group in three forms, and the global top-K.

Ties are always settled by a second sort key, so a result never depends on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def topk_per_group(df: DataFrame, groups: list[str], order: list[Column], k: int) -> DataFrame:
    """K first rows per group by window rank, plus the rank ``rn``.

    Spark cuts every task's rows to K a group before the shuffle (WindowGroupLimit), so a hot
    group sends K rows a task, not itself.
    """
    ranked = df.withColumn("rn", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked.where(F.col("rn") <= k)


def topk_two_level(
    df: DataFrame, groups: list[str], order: list[Column], spread: Column, k: int, buckets: int = 32
) -> DataFrame:
    """The same, ranked inside (group, bucket) first: a hot group is worked on by many tasks.

    Costs a second shuffle and sort. It pays where k rows from every task are too many for the one
    task that finishes a group; otherwise ``topk_per_group`` is faster.
    """
    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(spread), F.lit(buckets)))
    first = topk_per_group(bucketed, [*groups, "_bucket"], order, k)
    return topk_per_group(first.drop("_bucket", "rn"), groups, order, k)


def topk_dates_collected(
    daily: DataFrame, group: str, day: str, measure: str, k: int
) -> DataFrame:
    """The same for one row per (group, date), by collecting, sorting and cutting an array.

    Only for frames already aggregated to days: the array of a group is bounded by the number
    of calendar dates, about 365 a year, however many trips there are. The measure is negated so
    that equal measures fall back to the earlier date.
    """
    pairs = F.collect_list(F.struct((-F.col(measure)).alias("m"), F.col(day).alias("d")))
    return (
        daily.groupBy(group)
        .agg(F.slice(F.array_sort(pairs), 1, k).alias("best"))
        .select(group, F.posexplode("best").alias("pos", "pair"))
        .select(
            group,
            F.col("pair.d").alias(day),
            (-F.col("pair.m")).alias(measure),
            (F.col("pos") + 1).alias("rn"),
        )
    )


def global_topk(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """K first rows of all; Spark keeps K a task and merges (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(k)
