"""The six jobs and their variants."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tripflow.catalog.bounds import within_rank_error
from tripflow.catalog.inputs import (
    by_date,
    geo_csv,
    geo_from_csv,
    geo_from_inferred_csv,
    geo_from_lines,
    layout_by_day_hour,
    zone_from_csv_text,
    zones_from_csv,
)
from tripflow.catalog.registry import register, rounded
from tripflow.catalog.views import Inputs
from tripflow.functions.geo import haversine_arrow_udf, haversine_udf
from tripflow.operators.filters import prune_to_local
from tripflow.params import TripWindow
from tripflow.plans import best_days as q2
from tripflow.plans import hourly_profile as q1
from tripflow.plans.card_use import card_use, card_use_sql
from tripflow.plans.flows import borough_flows
from tripflow.plans.revenue_share import revenue_share
from tripflow.plans.zone_balance import zone_imbalance, zone_imbalance_merged

W = TripWindow()
HOURS = "(11, 12, 13, 14)"
DAYS = "(11, 12, 13)"

KM_SQL = """2 * 6371.0 * asin(sqrt(least(CAST(1 AS DOUBLE),
  pow(sin(radians(dropoff_latitude - pickup_latitude) / 2), 2)
  + cos(radians(pickup_latitude)) * cos(radians(dropoff_latitude))
    * pow(sin(radians(dropoff_longitude - pickup_longitude) / 2), 2))))"""
SECONDS_SQL = """(CAST(floor(epoch(dropoff_ts)) AS BIGINT)
  - CAST(floor(epoch(pickup_ts)) AS BIGINT))"""
NON_ZERO_SQL = """pickup_latitude <> 0 AND pickup_longitude <> 0
  AND dropoff_latitude <> 0 AND dropoff_longitude <> 0"""
BOUNDS_SQL = """pickup_latitude BETWEEN -90 AND 90 AND dropoff_latitude BETWEEN -90 AND 90
  AND pickup_longitude BETWEEN -180 AND 180 AND dropoff_longitude BETWEEN -180 AND 180"""


def profile_sql(where: str) -> str:
    return f"""
WITH measured AS (
  SELECT CAST(hour(pickup_ts) AS INT) AS pickup_hour, {SECONDS_SQL} AS seconds,
         round({KM_SQL}, 6) AS km
  FROM trips_geo
  WHERE hour(pickup_ts) IN {HOURS} AND {SECONDS_SQL} > 0 AND {NON_ZERO_SQL} AND {where}
)
SELECT pickup_hour, count(*) AS trips,
       round(CAST(sum(seconds) AS DOUBLE) / count(*) / 60, 6) AS avg_duration_min,
       quantile_disc(km, 0.9) AS p90_km
FROM measured GROUP BY pickup_hour
"""


_PROFILE = profile_sql(BOUNDS_SQL)
_GEO = ("trips_geo",)


def _profile(df):
    return rounded(df, avg_duration_min=6)


@register("q1_hourly_profile", _PROFILE, _GEO)
def _q1(t: Inputs):
    return _profile(q1.hourly_profile(t["trips_geo"], W))


@register("q1_hourly_profile_two_scans", _PROFILE, _GEO)
def _q1_two_scans(t: Inputs):
    return _profile(q1.hourly_profile(t["trips_geo"], W, write_rows=False))


@register("q1_hourly_profile_sql", _PROFILE, _GEO)
def _q1_sql(t: Inputs):
    return _profile(q1.hourly_profile_sql(t["trips_geo"], W))


@register("q1_hourly_profile_udf", _PROFILE, _GEO)
def _q1_udf(t: Inputs):
    return _profile(q1.hourly_profile(t["trips_geo"], W, distance=haversine_udf))


@register("q1_hourly_profile_arrow_udf", _PROFILE, _GEO)
def _q1_arrow(t: Inputs):
    return _profile(q1.hourly_profile(t["trips_geo"], W, distance=haversine_arrow_udf))


@register("q1_hourly_profile_csv", _PROFILE, _GEO)
def _q1_csv(t: Inputs):
    return _profile(q1.hourly_profile(geo_from_csv(t, geo_csv(t)), W))


@register(
    "q1_hourly_profile_paid", profile_sql("trip_distance > 0 AND fare_amount > 0"), _GEO
)
def _q1_paid(t: Inputs):
    return _profile(q1.hourly_profile(t["trips_geo"], W, bounds=False, paid_only=True))


@register(
    "q1_hourly_profile_approx",
    f"""SELECT pickup_hour, trips, avg_duration_min, true AS within_bound FROM ({_PROFILE})""",
    _GEO,
)
def _q1_approx(t: Inputs):
    found = q1.hourly_profile_approx(t["trips_geo"], W)
    km = q1.profile_rows(t["trips_geo"], W).select("pickup_hour", F.col("km").alias("value"))
    checked = within_rank_error(found.withColumnRenamed("p90_km", "p90"), km, "pickup_hour", "trips")
    return _profile(checked.select("pickup_hour", "trips", "avg_duration_min", "within_bound"))


@register("q1_hourly_profile_lines", _PROFILE, _GEO)
def _q1_lines(t: Inputs):
    return _profile(q1.hourly_profile(geo_from_lines(t), W))


@register("q1_hourly_profile_sql_csv", _PROFILE, _GEO)
def _q1_sql_csv(t: Inputs):
    return _profile(q1.hourly_profile_sql(geo_from_inferred_csv(t), W))


@register(
    "q1_hourly_profile_non_zero", profile_sql("true"), _GEO
)
def _q1_non_zero(t: Inputs):
    return _profile(q1.hourly_profile(t["trips_geo"], W, bounds=False))


_BEST_DAYS = f"""
WITH daily AS (
  SELECT vendor_id, CAST(pickup_ts AS DATE) AS pickup_date,
         avg(tip_amount / trip_distance) AS mean
  FROM trips_geo
  WHERE hour(pickup_ts) IN {HOURS} AND trip_distance > 0 AND fare_amount > 0
    AND vendor_id IS NOT NULL AND tip_amount IS NOT NULL
  GROUP BY 1, 2
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY mean DESC, pickup_date) AS place
  FROM daily
)
SELECT vendor_id, pickup_date, round(mean, 6) AS avg_tip_per_distance
FROM placed WHERE place <= {W.top_k}
"""


def _best(df):
    return rounded(df, avg_tip_per_distance=6)


@register("q2_best_days", _BEST_DAYS, _GEO)
def _q2(t: Inputs):
    return _best(q2.best_days(t["trips_geo"], W))


@register("q2_best_days_sql", _BEST_DAYS, _GEO)
def _q2_sql(t: Inputs):
    return _best(q2.best_days_sql(t["trips_geo"], W))


@register("q2_best_days_collect", _BEST_DAYS, _GEO)
def _q2_collect(t: Inputs):
    return _best(q2.best_days_collected(t["trips_geo"], W))


@register("q2_best_days_lines", _BEST_DAYS, _GEO)
def _q2_lines(t: Inputs):
    return _best(q2.best_days(geo_from_lines(t), W))


@register("q2_best_days_two_level", _BEST_DAYS, _GEO)
def _q2_two_level(t: Inputs):
    return _best(q2.best_days_two_level(t["trips_geo"], W))


IN_WINDOW_SQL = f"day(pickup_ts) IN {DAYS} AND hour(pickup_ts) IN {HOURS}"
_ZONE = ("trips_zone", "zones")


_FLOWS = f"""
SELECT p.borough AS pickup_borough, d.borough AS dropoff_borough, count(*) AS trips
FROM trips_zone t
JOIN zones p ON t.pu_location_id = p.location_id
JOIN zones d ON t.do_location_id = d.location_id
WHERE {IN_WINDOW_SQL} AND p.borough <> d.borough
GROUP BY 1, 2
ORDER BY trips DESC, pickup_borough, dropoff_borough LIMIT {W.top_k}
"""


@register("q3_flows", _FLOWS, _ZONE)
def _q3(t: Inputs):
    return borough_flows(layout_by_day_hour(t), t["zones"], W)


@register("q3_flows_unpruned", _FLOWS, _ZONE)
def _q3_unpruned(t: Inputs):
    return borough_flows(t["trips_zone"], t["zones"], W)


_CARD = f"""
SELECT borough AS pickup_borough, count(*) AS trips,
       round(avg(CASE WHEN payment_type = 1 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS card_share,
       round(avg(CASE WHEN payment_type = 1 AND fare_amount > 0
                      THEN tip_amount / fare_amount END), 6) AS avg_tip_rate_card
FROM trips_zone JOIN zones ON pu_location_id = location_id
WHERE {IN_WINDOW_SQL}
GROUP BY borough
"""


def _card(df):
    return rounded(df, card_share=6, avg_tip_rate_card=6)


@register("q4_card_use", _CARD, _ZONE)
def q4_card_use(t: Inputs):
    return _card(card_use(layout_by_day_hour(t), t["zones"], W))


@register("q4_card_use_unpruned", _CARD, _ZONE)
def _q4_unpruned(t: Inputs):
    return _card(card_use(t["trips_zone"], t["zones"], W))


@register("q4_card_use_sql", _CARD, _ZONE)
def _q4_sql(t: Inputs):
    return _card(card_use_sql(layout_by_day_hour(t), t["zones"], W))


@register("q4_card_use_sql_csv", _CARD, _ZONE)
def _q4_sql_csv(t: Inputs):
    return _card(card_use_sql(zone_from_csv_text(t), zones_from_csv(t), W))


@register(
    "q4_card_use_new_york",
    _CARD.replace("(pickup_ts)", "(timezone('America/New_York', timezone('UTC', pickup_ts)))"),
    _ZONE,
)
def _q4_zoned(t: Inputs):
    """Days and hours of a named zone, from the one layout in UTC."""
    local = replace(W, zone="America/New_York")
    return _card(card_use(prune_to_local(layout_by_day_hour(t), local), t["zones"], local))


@register(
    "q4_card_use_new_york_layout",
    _CARD.replace("(pickup_ts)", "(timezone('America/New_York', timezone('UTC', pickup_ts)))"),
    _ZONE,
)
def _q4_zone_layout(t: Inputs):
    """The same from a layout written for that zone."""
    local = replace(W, zone="America/New_York")
    return _card(card_use(layout_by_day_hour(t, local.zone), t["zones"], local))


def _dates_of_window(t: Inputs):
    return t.spark.read.parquet(by_date(t)).where(F.dayofmonth("pickup_date").isin(W.days)).drop("pickup_date")


@register("q4_card_use_partitioned", _CARD, _ZONE)
def _q4_partitioned(t: Inputs):
    """From the layout by date: its folders are picked by their day of the month, hours by the time."""
    return _card(card_use(_dates_of_window(t), t["zones"], W))


@register("q4_card_use_csv", _CARD, _ZONE)
def _q4_csv(t: Inputs):
    return _card(card_use(zone_from_csv_text(t), t["zones"], W))


_IMBALANCE = f"""
WITH kept AS (SELECT * FROM trips_zone WHERE {IN_WINDOW_SQL}),
p AS (
  SELECT borough, zone, count(*) AS n FROM kept LEFT JOIN zones ON pu_location_id = location_id
  GROUP BY 1, 2
),
d AS (
  SELECT borough, zone, count(*) AS n FROM kept LEFT JOIN zones ON do_location_id = location_id
  GROUP BY 1, 2
),
merged AS (
  SELECT coalesce(p.borough, d.borough) AS borough, coalesce(p.zone, d.zone) AS zone,
         coalesce(p.n, 0) AS pickups, coalesce(d.n, 0) AS dropoffs
  FROM p FULL JOIN d ON p.borough = d.borough AND p.zone = d.zone
)
SELECT borough, zone, pickups, dropoffs,
       round(CAST(greatest(pickups, dropoffs) AS DOUBLE)
             / greatest(1, least(pickups, dropoffs)), 6) AS imbalance
FROM merged
ORDER BY imbalance DESC, pickups DESC, dropoffs DESC, borough NULLS FIRST, zone NULLS FIRST
LIMIT {W.top_k}
"""


@register("q5_imbalance", _IMBALANCE, _ZONE)
def _q5(t: Inputs):
    return zone_imbalance(layout_by_day_hour(t), t["zones"], W)


@register("q5_imbalance_unpruned", _IMBALANCE, _ZONE)
def _q5_unpruned(t: Inputs):
    return zone_imbalance(t["trips_zone"], t["zones"], W)


@register(
    "q5_imbalance_kathmandu",
    _IMBALANCE.replace("(pickup_ts)", "(timezone('Asia/Kathmandu', timezone('UTC', pickup_ts)))"),
    _ZONE,
)
def _q5_zoned(t: Inputs):
    """A zone that is 5 hours and 45 minutes ahead, from the same layout in UTC."""
    local = replace(W, zone="Asia/Kathmandu")
    return zone_imbalance(prune_to_local(layout_by_day_hour(t), local), t["zones"], local)


@register("join_strategy_broadcast", _IMBALANCE, _ZONE)
def _q5_broadcast(t: Inputs):
    return zone_imbalance_merged(layout_by_day_hour(t), t["zones"], W, strategy="broadcast")


@register("join_strategy_merge", _IMBALANCE, _ZONE)
def _q5_merge(t: Inputs):
    return zone_imbalance_merged(layout_by_day_hour(t), t["zones"], W, strategy="merge")


_REVENUE = f"""
WITH sums AS (
  SELECT vendor_id, service_zone, count(*) AS trips,
         sum(coalesce(total_amount, 0)) AS revenue,
         sum(coalesce(congestion_surcharge, 0) + coalesce(airport_fee, 0)) AS extra
  FROM trips_zone JOIN zones ON pu_location_id = location_id
  WHERE {IN_WINDOW_SQL}
  GROUP BY 1, 2
)
SELECT vendor_id, service_zone, trips, round(revenue, 4) AS total_revenue,
       round(extra, 4) AS surcharge_revenue,
       round(CASE WHEN revenue > 0 THEN extra / revenue ELSE 0 END, 6) AS surcharge_share,
       round(revenue / trips, 4) AS revenue_per_trip
FROM sums
"""


def _revenue(df):
    return rounded(
        df, total_revenue=4, surcharge_revenue=4, surcharge_share=6, revenue_per_trip=4
    )


@register("q6_revenue_share", _REVENUE, _ZONE)
def _q6(t: Inputs):
    return _revenue(revenue_share(layout_by_day_hour(t), t["zones"], W))


@register("q6_revenue_share_unpruned", _REVENUE, _ZONE)
def _q6_unpruned(t: Inputs):
    return _revenue(revenue_share(t["trips_zone"], t["zones"], W))


@register("q6_revenue_share_partitioned", _REVENUE, _ZONE)
def _q6_partitioned(t: Inputs):
    """From the layout by date."""
    return _revenue(revenue_share(_dates_of_window(t), t["zones"], W))
