"""Estimates checked against the exact counts that they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH_ACCURACY = 10_000  # fixed value: Spark's default for percentile_approx
FRACTION = 0.9


def within_rank(found: DataFrame, rows: DataFrame, key: str, n: str, estimate: str, slack: Column) -> DataFrame:
    """``found`` with ``within_bound``: whether the rank of the estimate among (key, value) misses the
    wanted one by ``slack`` at most. ``found`` has one row a key and the number of its rows in ``n``."""
    counted = (
        rows.join(found.select(key, estimate), key)
        .groupBy(key)
        .agg(
            F.count(F.when(F.col("value") < F.col(estimate), 1)).alias("below"),
            F.count(F.when(F.col("value") <= F.col(estimate), 1)).alias("up_to"),
        )
    )
    rank = F.ceil(F.lit(FRACTION) * F.col(n))
    within = (F.col("below") - slack <= rank) & (rank <= F.col("up_to") + slack)
    return found.join(counted, key).withColumn("within_bound", within).drop("below", "up_to")


def within_rank_error(found: DataFrame, rows: DataFrame, key: str, n: str) -> DataFrame:
    """``found`` with ``within_bound``: whether the rank of ``p90`` misses by n / accuracy + 1 at most.

    ``rows`` holds (key, value), the values the sketch has seen. ``found`` has one row a key.
    """
    return within_rank(found, rows, key, n, "p90", F.col(n) / SKETCH_ACCURACY + 1)


def within_sample_size(sampled: DataFrame, rows: DataFrame, key: str, rate: float) -> DataFrame:
    """(key, trips, within_bound): whether the sample of a key is within six standard deviations.

    ``sampled`` has (key, sampled); ``rows`` are those the sample was drawn from.
    """
    full = rows.groupBy(key).agg(F.count("*").alias("trips"))
    sampled_rows = F.coalesce(F.col("sampled"), F.lit(0))
    spread = 6 * F.sqrt(F.col("trips") * rate * (1 - rate)) + 1
    within = F.abs(sampled_rows - F.col("trips") * rate) <= spread
    return full.join(sampled, key, "left").select(key, "trips", within.alias("within_bound"))
