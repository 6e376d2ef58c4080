"""The hourly profile from a small table of sketches, one row a date and hour, instead of from trips.

A sketch (KLL) stands for the distances of one date and hour in a few kilobytes. Sketches merge, so
the profile of any window of dates and hours is a merge of rows of that table; trips are not read again.
New trips, also late ones of a date that is there already, are sketched apart and appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripflow.params import TripWindow
from tripflow.plans.hourly_profile import PERCENTILE, profile_rows

#: Size of a sketch; its greatest is 65,535.
SKETCH_K = 4096
ALL_HOURS = TripWindow(hour_start=0, hour_count=24)


def rank_error(k: int = SKETCH_K) -> float:
    """Rank error of a KLL sketch, as a share of its rows, with 99 % confidence. Its fit."""
    return 2.296 / k**0.9021


def sketch_trips(trips: DataFrame, k: int = SKETCH_K, **row_options) -> DataFrame:
    """(pickup_date, pickup_hour, trips, seconds, km_sketch) of the qualifying trips of all hours.

    Rows are sketched task by task and merged; a hot hour sends one sketch a task.
    """
    rows = profile_rows(trips, ALL_HOURS, keep=("pickup_ts",), **row_options)
    measured = rows.where(~F.isnan("km")).withColumn("pickup_date", F.to_date("pickup_ts"))
    return measured.groupBy("pickup_date", "pickup_hour").agg(
        F.count("*").alias("trips"), F.sum("seconds").alias("seconds"),
        F.kll_sketch_agg_double("km", F.lit(k)).alias("km_sketch"),
    )


def profile_from_sketches(sketches: DataFrame, window: TripWindow, k: int = SKETCH_K) -> DataFrame:
    """(pickup_hour, trips, avg_duration_min, p90_km) of the days and hours of the window."""
    kept = sketches.where(F.dayofmonth("pickup_date").isin(window.days) & F.col("pickup_hour").isin(window.hours))
    merged = kept.groupBy("pickup_hour").agg(
        F.sum("trips").alias("trips"), F.sum("seconds").alias("seconds"),
        F.kll_merge_agg_double("km_sketch", F.lit(k)).alias("km_sketch"),
    )
    return merged.select(
        "pickup_hour", "trips", (F.col("seconds") / F.col("trips") / F.lit(60.0)).alias("avg_duration_min"),
        F.kll_sketch_get_quantile_double("km_sketch", F.lit(PERCENTILE)).alias("p90_km"),
    ).orderBy("pickup_hour")
