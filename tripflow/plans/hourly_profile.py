"""Hourly trip profile: trips, mean minutes and 90th percentile of distance per pickup hour."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripflow.functions.geo import KM_DECIMALS, KM_ORDINAL_BITS, haversine_km
from tripflow.functions.times import whole_seconds
from tripflow.operators.filters import in_hours, positive, valid_coordinates
from tripflow.operators.mergeable import BottomK
from tripflow.operators.sampling import seeded_hash
from tripflow.operators.selection import nearest_rank, quantise
from tripflow.operators.user_aggregates import aggregate_by_key
from tripflow.params import TripWindow
from tripflow.sources.staging import settle

PERCENTILE = 0.9  # fixed value: the percentile of the report
#: Rows of a sample of an hour: its 90th percentile's rank is then off by about 1 % of the hour at most.
SAMPLE_ROWS = 100_000

Distance = Callable[[Column, Column, Column, Column], Column]


def profile_rows(
    trips: DataFrame,
    window: TripWindow,
    distance: Distance = haversine_km,
    bounds: bool = True,
    paid_only: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Qualifying trips as (pickup_hour, seconds, km), plus the columns in ``keep``."""
    seconds = whole_seconds(F.col("pickup_ts"), F.col("dropoff_ts"))
    # A missing time or coordinate fails these tests, so no separate null guard is needed.
    wanted = (
        in_hours(F.col("pickup_ts"), window)
        & (seconds > 0)
        & valid_coordinates(bounds=bounds)
    )
    if paid_only:
        wanted = wanted & positive("trip_distance", "fare_amount")
    km = distance(
        F.col("pickup_latitude"),
        F.col("pickup_longitude"),
        F.col("dropoff_latitude"),
        F.col("dropoff_longitude"),
    )
    return trips.where(wanted).select(
        F.hour("pickup_ts").alias("pickup_hour"), seconds.alias("seconds"), km.alias("km"), *keep
    )


def _mean_minutes(seconds: Column, rows: Column) -> Column:
    return (seconds / rows / F.lit(60.0)).alias("avg_duration_min")


def hourly_profile(
    trips: DataFrame, window: TripWindow, write_rows: bool = True, **row_options
) -> DataFrame:
    """Exact profile: one scan of the trips and small shuffles, however skewed the hours are.

    Rank selection reads its rows twice. The qualifying rows are a few hours of the day and three
    narrow columns, so they are written to the shared folder once and read from there: a second
    scan of six columns of all trips would cost many times that, and the distance is computed
    once. ``write_rows=False`` scans twice instead and runs nothing before an action.

    There are at most 24 hours, which is the bound that makes the per-hour side broadcastable.
    """
    rows = profile_rows(trips, window, **row_options)
    per_hour = nearest_rank(
        settle(rows, "profile_rows") if write_rows else rows,
        ["pickup_hour"],
        "km",
        PERCENTILE,
        KM_DECIMALS,
        KM_ORDINAL_BITS,
        totals={"seconds": F.sum("seconds")},
        few_keys=True,
        name="p90_km",
    )
    return per_hour.select(
        "pickup_hour",
        F.col("rows").alias("trips"),
        _mean_minutes(F.col("seconds"), F.col("rows")),
        "p90_km",
    ).orderBy("pickup_hour")


def hourly_profile_approx(
    trips: DataFrame, window: TripWindow, accuracy: int | None = None, **row_options
) -> DataFrame:
    """Sketched percentile: one scan, one shuffle; rank error at most rows / accuracy."""
    sketch = (
        F.percentile_approx("km", PERCENTILE)
        if accuracy is None
        else F.percentile_approx("km", PERCENTILE, accuracy)
    )
    return (
        profile_rows(trips, window, **row_options)
        .groupBy("pickup_hour")
        .agg(
            F.count("*").alias("trips"),
            F.avg(F.col("seconds") / F.lit(60.0)).alias("avg_duration_min"),
            sketch.alias("p90_km"),
        )
        .orderBy("pickup_hour")
    )


def p90_by_hour(rows: DataFrame) -> DataFrame:
    """(pickup_hour, trips, p90_km): exact percentile of all of (pickup_hour, km), which should be a
    written table."""
    return nearest_rank(
        rows, ["pickup_hour"], "km", PERCENTILE, KM_DECIMALS, KM_ORDINAL_BITS,
        few_keys=True, name="p90_km",
    ).withColumnRenamed("rows", "trips")


def p90_by_sample(rows: DataFrame, id: str = "trip_id", k: int = SAMPLE_ROWS) -> DataFrame:
    """(pickup_hour, trips, sampled, p90_sampled, rank_error) from at most ``k`` rows an hour.

    ``rows`` are (pickup_hour, id, km) and are read once. The sample is that of the k smallest seeded
    hashes of the id, so it is uniform, the same on every run and in every split, and what is shuffled
    is k rows an hour and task, whatever the number of trips. ``rank_error`` bounds how far the
    estimate's rank among the hour's trips is from the wanted one (see ``BottomK``).
    """
    km = F.round("km", KM_DECIMALS).alias("km")
    hashed = rows.select("pickup_hour", seeded_hash(F.col(id)).alias("hash"), km)
    found = aggregate_by_key(hashed, ["pickup_hour"], ["hash", "km"], BottomK(k, PERCENTILE))
    return found.select(
        "pickup_hour", F.col("rows").alias("trips"), "sampled",
        F.col("estimate").alias("p90_sampled"), "rank_error",
    )


def hourly_profile_sampled(
    trips: DataFrame, window: TripWindow, id: str = "trip_id", k: int | None = SAMPLE_ROWS, **row_options
) -> DataFrame:
    """Exact counts and means, joined on the hour with a percentile from a bounded sample of each hour.

    Nothing is written and no rank is searched; the exact profile stays the default. With ``k=None`` the
    sample is every row of the hour: its rank is then searched over the written rows and has no error.
    """
    rows = profile_rows(trips, window, keep=(id,), **row_options)
    if k is None:
        rows = settle(rows.select("pickup_hour", "seconds", "km"), "profile_rows")
        found = p90_by_hour(rows.select("pickup_hour", "km")).select(
            "pickup_hour", F.col("trips").alias("sampled"), F.col("p90_km").alias("p90_sampled"), F.lit(0.0).alias("rank_error")
        )
    else:
        found = p90_by_sample(rows.select("pickup_hour", id, "km"), id, k)
    full = rows.groupBy("pickup_hour").agg(F.count("*").alias("n"), F.sum("seconds").alias("seconds"))
    return (
        full.join(found, "pickup_hour", "left")
        .select("pickup_hour", F.col("n").alias("trips"), _mean_minutes(F.col("seconds"), F.col("n")),
                "sampled", "p90_sampled", "rank_error")
        .orderBy("pickup_hour")
    )


# Rank by rank in one text: steps of 2^18 micro-kilometres are counted first, then the single
# distances of the one step that holds the wanted rank.
_SQL = """
FROM (
  SELECT pickup_hour, micro_km, any_value(rows_below) AS rows_below, any_value(trips) AS trips,
         any_value(all_seconds) AS seconds, count(*) AS here
  FROM {rows} JOIN (
    SELECT pickup_hour AS hour, step AS wanted_step, rows_up_to - n AS rows_below, trips,
           all_seconds
    FROM (
      SELECT pickup_hour, micro_km >> 18 AS step, count(*) AS n,
             sum(count(*)) OVER steps AS rows_up_to,
             sum(count(*)) OVER hours AS trips, sum(sum(seconds)) OVER hours AS all_seconds
      FROM {rows} GROUP BY ALL
      WINDOW hours AS (PARTITION BY pickup_hour),
             steps AS (PARTITION BY pickup_hour ORDER BY micro_km >> 18)
    ) WHERE ceil(:p * trips) BETWEEN rows_up_to - n + 1 AND rows_up_to
  ) ON pickup_hour = hour AND micro_km >> 18 = wanted_step
  GROUP BY pickup_hour, micro_km
)
|> EXTEND rows_below + sum(here) OVER (PARTITION BY pickup_hour ORDER BY micro_km) AS rank
|> WHERE ceil(:p * trips) BETWEEN rank - here + 1 AND rank
|> SELECT pickup_hour, trips, seconds / trips / 60D AS avg_duration_min,
          micro_km / 1000000D AS p90_km
|> ORDER BY pickup_hour
"""


def hourly_profile_sql(trips: DataFrame, window: TripWindow, **row_options) -> DataFrame:
    """The exact profile with its ranking as SQL, over the written qualifying rows."""
    rows = profile_rows(trips, window, **row_options)
    narrow = rows.select(
        "pickup_hour", "seconds", quantise(F.col("km"), KM_DECIMALS).alias("micro_km")
    ).where("micro_km IS NOT NULL")
    return trips.sparkSession.sql(
        _SQL, args={"p": PERCENTILE}, rows=settle(narrow, "profile_rows")
    )
