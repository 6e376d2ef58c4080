"""Projections, filters and scalar functions, over all rows of a trip table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripflow.catalog.jobs import BOUNDS_SQL, KM_SQL, NON_ZERO_SQL, SECONDS_SQL
from tripflow.catalog.layouts import DATES, DATES_SQL
from tripflow.catalog.registry import register, rounded
from tripflow.catalog.views import Inputs
from tripflow.functions import geo, times, values
from tripflow.operators import filters
from tripflow.params import TripWindow
from tripflow.plans.zone_balance import zone_counts_merged

W = TripWindow()
ALWAYS = TripWindow(hour_start=0, hour_count=24, day_start=1, day_count=31)
NIGHT = TripWindow(hour_start=22)
_GEO, _ZONE = ("trips_geo",), ("trips_zone",)
_CORNERS = ("pickup_latitude", "pickup_longitude", "dropoff_latitude", "dropoff_longitude")


@register(
    "project_cast_rename",
    """SELECT trip_id, CAST(vendor_id AS VARCHAR) AS vendor, CAST(pickup_ts AS DATE) AS pickup_date,
              CAST(trunc(fare_amount) AS INT) AS fare_whole,
              CAST(payment_type AS DOUBLE) AS payment_code
       FROM trips_zone""",
    _ZONE,
)
def _project(t: Inputs):
    return t["trips_zone"].select(
        "trip_id",
        F.col("vendor_id").cast("string").alias("vendor"),
        F.col("pickup_ts").cast("date").alias("pickup_date"),
        F.col("fare_amount").cast("int").alias("fare_whole"),
        F.col("payment_type").cast("double").alias("payment_code"),
    )


@register(
    "hour_window_filter",
    "SELECT trip_id, pickup_ts FROM trips_zone WHERE hour(pickup_ts) IN (22, 23, 0, 1)",
    _ZONE,
)
def _hour_window(t: Inputs):
    kept = filters.in_hours(F.col("pickup_ts"), NIGHT)
    return t["trips_zone"].where(kept).select("trip_id", "pickup_ts")


@register(
    "hour_range_filter",
    "SELECT trip_id, pickup_ts FROM trips_zone WHERE hour(pickup_ts) >= 22",
    _ZONE,
)
def _hour_range(t: Inputs):
    kept = filters.in_hours(F.col("pickup_ts"), TripWindow(hour_start=22, wrap=False))
    return t["trips_zone"].where(kept).select("trip_id", "pickup_ts")


@register(
    "day_hour_filter",
    """SELECT trip_id, pickup_ts FROM trips_zone
       WHERE day(pickup_ts) IN (27, 28, 29) AND hour(pickup_ts) IN (22, 23, 0, 1)""",
    _ZONE,
)
def _day_hour(t: Inputs):
    late = TripWindow(hour_start=22, day_start=27)
    df = t["trips_zone"]
    return df.where(filters.in_window(df, late)).select("trip_id", "pickup_ts")


@register(
    "date_list_filter",
    f"SELECT trip_id, pickup_ts FROM trips_zone WHERE CAST(pickup_ts AS DATE) IN {DATES_SQL}",
    _ZONE,
)
def _date_list(t: Inputs):
    kept = filters.on_dates(F.to_date("pickup_ts"), DATES)
    return t["trips_zone"].where(kept).select("trip_id", "pickup_ts")


@register(
    "not_null_filter",
    """SELECT trip_id, congestion_surcharge, airport_fee FROM trips_zone
       WHERE pickup_ts IS NOT NULL AND congestion_surcharge IS NOT NULL
         AND airport_fee IS NOT NULL""",
    _ZONE,
)
def _not_null(t: Inputs):
    kept = filters.present("pickup_ts", "congestion_surcharge", "airport_fee")
    return t["trips_zone"].where(kept).select("trip_id", "congestion_surcharge", "airport_fee")


@register(
    "geo_valid_filter",
    f"SELECT trip_id, {', '.join(_CORNERS)} FROM trips_geo WHERE {NON_ZERO_SQL} AND {BOUNDS_SQL}",
    _GEO,
)
def _geo_valid(t: Inputs):
    return t["trips_geo"].where(filters.valid_coordinates()).select("trip_id", *_CORNERS)


@register(
    "positive_measure_filter",
    f"""SELECT trip_id, trip_distance, fare_amount FROM trips_geo
        WHERE trip_distance > 0 AND fare_amount > 0 AND {SECONDS_SQL} > 0""",
    _GEO,
)
def _positive(t: Inputs):
    seconds = times.whole_seconds(F.col("pickup_ts"), F.col("dropoff_ts"))
    kept = filters.positive("trip_distance", "fare_amount") & (seconds > 0)
    return t["trips_geo"].where(kept).select("trip_id", "trip_distance", "fare_amount")


@register(
    "date_parts",
    """SELECT trip_id, CAST(hour(pickup_ts) AS INT) AS pickup_hour,
              CAST(day(pickup_ts) AS INT) AS pickup_day, CAST(pickup_ts AS DATE) AS pickup_date,
              strftime(pickup_ts, '%Y-%m-%d') AS pickup_date_text
       FROM trips_zone""",
    _ZONE,
)
def _date_parts(t: Inputs):
    return t["trips_zone"].select(
        "trip_id",
        F.hour("pickup_ts").alias("pickup_hour"),
        F.dayofmonth("pickup_ts").alias("pickup_day"),
        F.to_date("pickup_ts").alias("pickup_date"),
        F.date_format("pickup_ts", "yyyy-MM-dd").alias("pickup_date_text"),
    )


@register(
    "trip_duration",
    f"SELECT trip_id, round({SECONDS_SQL} / CAST(60 AS DOUBLE), 6) AS duration_min FROM trips_geo",
    _GEO,
)
def _duration(t: Inputs):
    minutes = times.duration_minutes(F.col("pickup_ts"), F.col("dropoff_ts"))
    return rounded(t["trips_geo"].select("trip_id", minutes.alias("duration_min")), duration_min=6)


@register(
    "parse_timestamp",
    """SELECT trip_id, CASE WHEN trip_id % 9 <> 0 AND trip_id % 10 <> 0
                            THEN pickup_ts END AS parsed
       FROM trips_zone""",
    _ZONE,
)
def _parse_timestamp(t: Inputs):
    text = (
        F.when(F.col("trip_id") % 9 == 0, F.lit("no time"))
        .when(F.col("trip_id") % 10 == 0, F.lit("2024-02-30T10:00:00.000000"))
        .otherwise(F.date_format("pickup_ts", times.ISO_MICROS_PATTERN))
    )
    df = t["trips_zone"].select("trip_id", text.alias("text"))
    return df.select("trip_id", times.parse_timestamp(F.col("text"), times.ISO_MICROS_PATTERN).alias("parsed"))


def _stamp_text(ts: Column, trip_id: Column) -> Column:
    """The pickup time in the spellings that occur, and some that are no time at all."""
    return (
        F.when(trip_id % 6 == 0, F.date_format(ts, times.PLAIN_MICROS_PATTERN))
        .when(trip_id % 6 == 1, F.date_format(ts, times.ISO_MICROS_PATTERN))
        .when(
            trip_id % 6 == 2,
            F.concat(F.date_format(ts, times.ISO_MICROS_PATTERN), F.lit("-05:00")),
        )
        .when(
            trip_id % 6 == 3,
            F.concat(F.date_format(ts, times.ISO_MICROS_PATTERN), F.lit("+00:00")),
        )
        .when(trip_id % 6 == 4, F.date_format(ts, "yyyy-MM-dd"))
        .otherwise(F.lit("2024-13-01 00:00:00"))
    )


@register(
    "normalise_iso_timestamp",
    """SELECT trip_id, CASE trip_id % 6 WHEN 4 THEN NULL WHEN 5 THEN NULL
                            WHEN 2 THEN pickup_ts + INTERVAL 5 HOUR ELSE pickup_ts END AS parsed
       FROM trips_zone""",
    _ZONE,
)
def _normalise(t: Inputs):
    df = t["trips_zone"].select(
        "trip_id", _stamp_text(F.col("pickup_ts"), F.col("trip_id")).alias("text")
    )
    return df.select("trip_id", times.normalise_iso(F.col("text")).alias("parsed"))


def _distances(t: Inputs, distance):
    km = distance(*[F.col(c) for c in _CORNERS])
    return rounded(t["trips_geo"].select("trip_id", km.alias("km")), km=6)


@register("haversine_expr", f"SELECT trip_id, round({KM_SQL}, 6) AS km FROM trips_geo", _GEO)
def _haversine(t: Inputs):
    return _distances(t, geo.haversine_km)


_GUARDED = f"""SELECT trip_id, CASE WHEN {NON_ZERO_SQL} THEN round({KM_SQL}, 6) END AS km
FROM trips_geo"""


@register("haversine_udf", _GUARDED, _GEO)
def _haversine_udf(t: Inputs):
    return _distances(t, geo.haversine_udf)


@register("haversine_arrow_udf", _GUARDED, _GEO)
def _haversine_arrow(t: Inputs):
    return _distances(t, geo.haversine_arrow_udf)


@register(
    "safe_ratio",
    """SELECT trip_id, CASE WHEN trip_distance <> 0 THEN tip_amount / trip_distance END
         AS tip_per_distance FROM trips_geo""",
    _GEO,
)
def _safe_ratio(t: Inputs):
    ratio = values.safe_ratio(F.col("tip_amount"), F.col("trip_distance"))
    return t["trips_geo"].select("trip_id", ratio.alias("tip_per_distance"))


@register(
    "imbalance_ratio",
    """WITH p AS (SELECT borough, zone, count(*) AS n FROM trips_zone
                  LEFT JOIN zones ON pu_location_id = location_id
                  GROUP BY 1, 2),
            d AS (SELECT borough, zone, count(*) AS n FROM trips_zone
                  LEFT JOIN zones ON do_location_id = location_id
                  GROUP BY 1, 2),
            m AS (SELECT coalesce(p.borough, d.borough) AS borough,
                         coalesce(p.zone, d.zone) AS zone,
                         coalesce(p.n, 0) AS a, coalesce(d.n, 0) AS b
                  FROM p FULL JOIN d ON p.borough = d.borough AND p.zone = d.zone)
       SELECT borough, zone,
              round(CAST(greatest(a, b) AS DOUBLE) / greatest(1, least(a, b)), 6) AS imbalance
       FROM m""",
    ("trips_zone", "zones"),
)
def _imbalance(t: Inputs):
    counts = zone_counts_merged(t["trips_zone"], t["zones"], ALWAYS)
    ratio = values.imbalance(F.col("pickups"), F.col("dropoffs"))
    return counts.select("borough", "zone", ratio.alias("imbalance"))


@register(
    "null_default",
    """SELECT trip_id, coalesce(congestion_surcharge, 0) + coalesce(airport_fee, 0) AS surcharges
       FROM trips_zone""",
    _ZONE,
)
def _null_default(t: Inputs):
    both = values.null_to_zero(F.col("congestion_surcharge")) + values.null_to_zero(
        F.col("airport_fee")
    )
    return t["trips_zone"].select("trip_id", both.alias("surcharges"))


@register(
    "zone_hour",
    """SELECT trip_id, CAST(hour(timezone('America/New_York', timezone('UTC', pickup_ts))) AS INT)
         AS local_hour FROM trips_zone""",
    _ZONE,
)
def _zone_hour(t: Inputs):
    hour = times.hour_in_zone(F.col("pickup_ts"), "America/New_York")
    return t["trips_zone"].select("trip_id", hour.alias("local_hour"))
