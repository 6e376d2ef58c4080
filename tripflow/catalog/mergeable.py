"""Aggregates whose states merge: user aggregates, bounded samples, and sketches kept as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripflow.catalog.bounds import within_rank
from tripflow.catalog.jobs import BOUNDS_SQL, DAYS, HOURS, KM_SQL, NON_ZERO_SQL, SECONDS_SQL, profile_sql
from tripflow.catalog.registry import register, rounded
from tripflow.catalog.views import Inputs
from tripflow.operators.mergeable import Moments
from tripflow.operators.sampling import SAMPLE_SEED
from tripflow.operators.user_aggregates import aggregate_by_key
from tripflow.params import TripWindow
from tripflow.plans import hourly_profile as q1
from tripflow.plans import profile_sketches
from tripflow.sources.staging import settle, written_once

W = TripWindow()
ALL_HOURS = TripWindow(hour_start=0, hour_count=24)
_GEO, _ZONE = ("trips_geo",), ("trips_zone",)
#: Test parameter: rows of an hour's sample, fewer than the test tables have an hour.
SAMPLED = 1000
_QUALIFIES = f"{SECONDS_SQL} > 0 AND {NON_ZERO_SQL} AND {BOUNDS_SQL}"

_MOMENTS = """
SELECT {key}, count(total_amount) AS rows, round(avg(total_amount), 6) AS mean,
       round(var_samp(total_amount), 4) AS variance, min(total_amount) AS least, max(total_amount) AS greatest
FROM trips_zone GROUP BY ALL
"""


@register("user_aggregate_moments", _MOMENTS.format(key="vendor_id, CAST(hour(pickup_ts) AS INT) AS pickup_hour"), _ZONE)
def _moments(t: Inputs):
    rows = t["trips_zone"].select("vendor_id", F.hour("pickup_ts").alias("pickup_hour"), "total_amount")
    found = aggregate_by_key(rows, ["vendor_id", "pickup_hour"], ["total_amount"], Moments())
    return rounded(found, mean=6, variance=4)


@register("user_aggregate_one_key", _MOMENTS.format(key="'all' AS scope"), _ZONE)
def _one_key(t: Inputs):
    """All rows under one key: every task sends one state."""
    rows = t["trips_zone"].select(F.lit("all").alias("scope"), "total_amount")
    return rounded(aggregate_by_key(rows, ["scope"], ["total_amount"], Moments()), mean=6, variance=4)


def _sample_sql(hours: str) -> str:
    """The sample, its percentile and its bound, and the exact percentile beside it."""
    return f"""
WITH measured AS (
  SELECT CAST(hour(pickup_ts) AS INT) AS pickup_hour, {SECONDS_SQL} AS seconds, round({KM_SQL}, 6) AS km,
         CAST('0x' || substr(md5('{SAMPLE_SEED}:' || trip_id), 1, 15) AS BIGINT) AS hash
  FROM trips_geo WHERE {_QUALIFIES} AND hour(pickup_ts) IN {hours}
),
placed AS (SELECT *, row_number() OVER (PARTITION BY pickup_hour ORDER BY hash, km) AS place FROM measured),
found AS (
  SELECT pickup_hour, count(*) AS trips, CAST(count(*) FILTER (place <= {SAMPLED}) AS INT) AS sampled,
         round(CAST(sum(seconds) AS DOUBLE) / count(*) / 60, 6) AS avg_duration_min,
         quantile_disc(km, 0.9) FILTER (place <= {SAMPLED}) AS p90_sampled, quantile_disc(km, 0.9) AS p90_km
  FROM placed GROUP BY pickup_hour
),
bounded AS (
  SELECT *, CASE WHEN sampled < trips THEN round(trips * (sqrt(ln(2 / 1e-9) / (2 * sampled)) + 1 / sampled), 4)
                 ELSE 0 END AS rank_error FROM found
)
SELECT {{columns}},
  (SELECT count(*) FILTER (km < p90_sampled) - rank_error <= ceil(0.9 * trips)
          AND ceil(0.9 * trips) <= count(*) FILTER (km <= p90_sampled) + rank_error
   FROM measured m WHERE m.pickup_hour = b.pickup_hour) AS within_bound
FROM bounded b
"""


_EVERY_HOUR = f"({', '.join(map(str, range(24)))})"


@register(
    "p90_bounded_sample",
    _sample_sql(_EVERY_HOUR).format(columns="pickup_hour, trips, sampled, p90_sampled, p90_km, rank_error"),
    _GEO,
)
def _p90_bounded(t: Inputs):
    """At most so many rows an hour, with the exact percentile and the sample's error beside it."""
    rows = q1.profile_rows(t["trips_geo"], ALL_HOURS, keep=("trip_id",))
    rows = settle(rows.select("pickup_hour", "trip_id", "km"), "profile_rows")
    found = q1.p90_by_sample(rows, k=SAMPLED).join(q1.p90_by_hour(rows.select("pickup_hour", "km")).drop("trips"), "pickup_hour")
    values = rows.select("pickup_hour", F.round("km", 6).alias("value"))
    return rounded(within_rank(settle(found, "found"), values, "pickup_hour", "trips", "p90_sampled", F.col("rank_error")), rank_error=4)


@register(
    "q1_hourly_profile_sampled",
    f"SELECT pickup_hour, trips, avg_duration_min, trips AS sampled, p90_km FROM ({profile_sql(BOUNDS_SQL)})",
    _GEO,
)
def _q1_sampled(t: Inputs):
    """The percentile stands on every row of the hour; ``p90_bounded_sample`` has that of a bounded sample."""
    found = q1.hourly_profile_sampled(t["trips_geo"], W, k=None).withColumnRenamed("p90_sampled", "p90_km")
    return rounded(found.drop("rank_error"), avg_duration_min=6)


def sketch_table(t: Inputs) -> str:
    """The sketches of all trips, kept as a table."""

    def write(out: str) -> None:
        profile_sketches.sketch_trips(t["trips_geo"]).write.parquet(out)

    return written_once(t.spark, "profile_sketches", t.sf_dir, write)


@register(
    "q1_hourly_profile_stored_sketch",
    f"""SELECT CAST(hour(pickup_ts) AS INT) AS pickup_hour, count(*) AS trips,
               round(CAST(sum({SECONDS_SQL}) AS DOUBLE) / count(*) / 60, 6) AS avg_duration_min,
               true AS within_bound
        FROM trips_geo WHERE {_QUALIFIES} AND hour(pickup_ts) IN {HOURS} AND day(pickup_ts) IN {DAYS}
        GROUP BY 1""",
    _GEO,
)
def _q1_stored(t: Inputs):
    """A window answered from the sketches alone; only the check of its error reads trips."""
    found = profile_sketches.profile_from_sketches(t.spark.read.parquet(sketch_table(t)), W)
    trips = t["trips_geo"].where(F.dayofmonth("pickup_ts").isin(W.days))
    km = q1.profile_rows(trips, W).select("pickup_hour", F.col("km").alias("value"))
    slack = 4 * profile_sketches.rank_error() * F.col("trips") + 1
    checked = within_rank(settle(found, "found"), km, "pickup_hour", "trips", "p90_km", slack)
    return rounded(checked.drop("p90_km"), avg_duration_min=6)
