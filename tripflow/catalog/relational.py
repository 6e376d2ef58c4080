"""Joins, aggregates, percentiles, samples and top-K, over whole trip tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripflow.catalog.bounds import within_rank_error, within_sample_size
from tripflow.catalog.jobs import BOUNDS_SQL, KM_SQL, NON_ZERO_SQL, SECONDS_SQL
from tripflow.catalog.registry import register, rounded
from tripflow.catalog.views import Inputs
from tripflow.functions.geo import KM_DECIMALS, KM_ORDINAL_BITS
from tripflow.operators import aggregates, joins, ranking, sampling, selection
from tripflow.params import TripWindow
from tripflow.plans.hourly_profile import profile_rows
from tripflow.sources.staging import settle

_GEO, _ZONE, _BOTH = ("trips_geo",), ("trips_zone",), ("trips_zone", "zones")
ALL_HOURS = TripWindow(hour_start=0, hour_count=24)
MONEY_DECIMALS, MONEY_BITS = 6, 50


@register(
    "inner_lookup_join",
    """SELECT trip_id, borough, zone FROM trips_zone JOIN zones ON pu_location_id = location_id""",
    _BOTH,
)
def _inner(t: Inputs):
    df = joins.lookup(t["trips_zone"], t["zones"], "pu_location_id")
    return df.select("trip_id", "borough", "zone")


@register(
    "roleplay_double_join",
    """SELECT trip_id, p.borough AS pickup_borough, d.borough AS dropoff_borough
       FROM trips_zone JOIN zones p ON pu_location_id = p.location_id
       JOIN zones d ON do_location_id = d.location_id""",
    _BOTH,
)
def _two_roles(t: Inputs):
    df, zones = t["trips_zone"], t["zones"]
    df = joins.lookup(df, zones, "pu_location_id", take={"borough": "pickup_borough"})
    df = joins.lookup(df, zones, "do_location_id", take={"borough": "dropoff_borough"})
    return df.select("trip_id", "pickup_borough", "dropoff_borough")


@register(
    "left_lookup_join",
    """SELECT trip_id, zone AS pickup_zone FROM trips_zone
       LEFT JOIN zones ON pu_location_id = location_id""",
    _BOTH,
)
def _left(t: Inputs):
    df = joins.lookup(
        t["trips_zone"], t["zones"], "pu_location_id", take={"zone": "pickup_zone"}, how="left"
    )
    return df.select("trip_id", "pickup_zone")


@register(
    "full_outer_merge",
    """WITH p AS (SELECT pu_location_id AS id, count(*) AS n FROM trips_zone GROUP BY 1),
            d AS (SELECT do_location_id AS id, count(*) AS n FROM trips_zone GROUP BY 1)
       SELECT coalesce(p.id, d.id) AS location_id, coalesce(p.n, 0) AS pickups,
              coalesce(d.n, 0) AS dropoffs
       FROM p FULL JOIN d ON p.id = d.id""",
    _ZONE,
)
def _full(t: Inputs):
    df = t["trips_zone"]

    def counted(key: str, alias: str):
        return df.groupBy(F.col(key).alias("location_id")).agg(F.count("*").alias(alias))

    return joins.full_outer_merge(
        counted("pu_location_id", "pickups"),
        counted("do_location_id", "dropoffs"),
        ["location_id"],
        ["pickups", "dropoffs"],
    )


def _with_hour(df):
    return df.withColumn("pickup_hour", F.hour("pickup_ts"))


@register(
    "agg_join_agg",
    """SELECT CAST(hour(pickup_ts) AS INT) AS pickup_hour, count(total_amount) AS rows,
              round(avg(total_amount), 6) AS mean FROM trips_zone GROUP BY 1""",
    _ZONE,
)
def _agg_join_agg(t: Inputs):
    df = aggregates.mean_by_join(_with_hour(t["trips_zone"]), ["pickup_hour"], "total_amount")
    return rounded(df, mean=6)


# The first eight digits of the MD5 of the id, as a number, modulo 50.
_SAMPLED = "CAST('0x' || substr(md5(CAST(trip_id AS VARCHAR)), 1, 8) AS BIGINT) % 50 = 0"


def _p90_of(df, keys: list[str], value: str, name: str = "p90"):
    return selection.nearest_rank(
        df, keys, value, 0.9, MONEY_DECIMALS, MONEY_BITS, few_keys=True, name=name
    )


@register(
    "agg_left_join_sample",
    f"""WITH a AS (SELECT CAST(hour(pickup_ts) AS INT) AS pickup_hour, count(*) AS trips
                   FROM trips_zone GROUP BY 1),
             s AS (SELECT CAST(hour(pickup_ts) AS INT) AS pickup_hour, count(*) AS sampled,
                          quantile_disc(total_amount, 0.9) AS p90
                   FROM trips_zone WHERE {_SAMPLED} GROUP BY 1)
        SELECT a.pickup_hour, trips, sampled, p90 FROM a LEFT JOIN s USING (pickup_hour)""",
    _ZONE,
)
def _agg_left_join_sample(t: Inputs):
    df = _with_hour(t["trips_zone"])
    full = df.groupBy("pickup_hour").agg(F.count("*").alias("trips"))
    sample = sampling.hash_sample(df, F.col("trip_id"), 50).select("pickup_hour", "total_amount")
    sample = settle(sample, "hash_sample")
    p90 = _p90_of(sample, ["pickup_hour"], "total_amount").withColumnRenamed("rows", "sampled")
    return full.join(p90, "pickup_hour", "left")


@register(
    "group_count",
    """SELECT pu_location_id, do_location_id, count(*) AS trips FROM trips_zone GROUP BY 1, 2""",
    _ZONE,
)
def _group_count(t: Inputs):
    return t["trips_zone"].groupBy("pu_location_id", "do_location_id").agg(
        F.count("*").alias("trips")
    )


@register(
    "group_avg",
    """SELECT vendor_id, CAST(hour(pickup_ts) AS INT) AS pickup_hour,
              round(avg(tip_amount), 7) AS mean_tip FROM trips_geo GROUP BY 1, 2""",
    _GEO,
)
def _group_avg(t: Inputs):
    df = _with_hour(t["trips_geo"]).groupBy("vendor_id", "pickup_hour").agg(
        F.avg("tip_amount").alias("mean_tip")
    )
    return rounded(df, mean_tip=7)


@register(
    "group_sum",
    """SELECT vendor_id, payment_type, count(*) AS trips, round(sum(total_amount), 4) AS revenue,
              round(sum(tip_amount), 4) AS tips FROM trips_zone GROUP BY 1, 2""",
    _ZONE,
)
def _group_sum(t: Inputs):
    df = t["trips_zone"].groupBy("vendor_id", "payment_type").agg(
        F.count("*").alias("trips"),
        F.sum("total_amount").alias("revenue"),
        F.sum("tip_amount").alias("tips"),
    )
    return rounded(df, revenue=4, tips=4)


@register(
    "conditional_share",
    """SELECT pu_location_id, round(avg(CASE WHEN payment_type = 1 THEN CAST(1 AS DOUBLE)
              ELSE 0 END), 6) AS card_share FROM trips_zone GROUP BY 1""",
    _ZONE,
)
def _conditional_share(t: Inputs):
    df = t["trips_zone"].groupBy("pu_location_id").agg(
        aggregates.share_where(F.col("payment_type") == 1).alias("card_share")
    )
    return rounded(df, card_share=6)


@register(
    "conditional_avg",
    """SELECT pu_location_id, round(avg(CASE WHEN payment_type = 1 AND fare_amount > 0
              THEN tip_amount / fare_amount END), 6) AS tip_rate FROM trips_zone GROUP BY 1""",
    _ZONE,
)
def _conditional_avg(t: Inputs):
    df = t["trips_zone"].groupBy("pu_location_id").agg(
        aggregates.avg_where(
            (F.col("payment_type") == 1) & (F.col("fare_amount") > 0),
            F.col("tip_amount") / F.col("fare_amount"),
        ).alias("tip_rate")
    )
    return rounded(df, tip_rate=6)


@register(
    "ratio_of_sums",
    """SELECT vendor_id, round(CASE WHEN sum(fare_amount) > 0
                THEN sum(tip_amount) / sum(fare_amount) ELSE 0 END, 6) AS tip_share,
              round(sum(fare_amount) / count(*), 4) AS fare_per_trip
       FROM trips_zone GROUP BY 1""",
    _ZONE,
)
def _ratio_of_sums(t: Inputs):
    tips, fares = F.sum("tip_amount"), F.sum("fare_amount")
    df = t["trips_zone"].groupBy("vendor_id").agg(
        F.when(fares > 0, tips / fares).otherwise(F.lit(0.0)).alias("tip_share"),
        (fares / F.count("*")).alias("fare_per_trip"),
    )
    return rounded(df, tip_share=6, fare_per_trip=4)


@register(
    "p90_approx",
    """SELECT CAST(hour(pickup_ts) AS INT) AS pickup_hour, count(*) AS trips, true AS within_bound
       FROM trips_geo GROUP BY 1""",
    _GEO,
)
def _p90_approx(t: Inputs):
    df = _with_hour(t["trips_geo"])
    found = df.groupBy("pickup_hour").agg(
        F.count("*").alias("trips"), F.percentile_approx("fare_amount", 0.9).alias("p90")
    )
    fares = df.select("pickup_hour", F.col("fare_amount").alias("value"))
    return within_rank_error(found, fares, "pickup_hour", "trips").drop("p90")


@register(
    "p90_nearest_rank",
    """SELECT vendor_id, CAST(hour(pickup_ts) AS INT) AS pickup_hour, count(*) AS trips,
              quantile_disc(round(fare_amount, 6), 0.9) AS p90 FROM trips_geo GROUP BY 1, 2""",
    _GEO,
)
def _p90_nearest_rank(t: Inputs):
    fares = _with_hour(t["trips_geo"]).select("vendor_id", "pickup_hour", "fare_amount")
    df = selection.nearest_rank(
        settle(fares, "fares"),
        ["vendor_id", "pickup_hour"],
        "fare_amount",
        0.9,
        MONEY_DECIMALS,
        MONEY_BITS,
        name="p90",
    )
    return df.withColumnRenamed("rows", "trips")


@register(
    "two_level_mean",
    """SELECT CAST(hour(pickup_ts) AS INT) AS pickup_hour, count(total_amount) AS rows,
              round(avg(total_amount), 6) AS mean FROM trips_zone GROUP BY 1""",
    _ZONE,
)
def _two_level_mean(t: Inputs):
    df = aggregates.two_level_mean(
        _with_hour(t["trips_zone"]), ["pickup_hour"], F.dayofmonth("pickup_ts"), "total_amount"
    )
    return rounded(df, mean=6)


def _p90_km(rows):
    return selection.nearest_rank(
        rows, ["pickup_hour"], "km", 0.9, KM_DECIMALS, KM_ORDINAL_BITS, few_keys=True, name="p90_km"
    ).withColumnRenamed("rows", "sampled")


@register(
    "p90_rate_sample",
    f"""SELECT CAST(hour(pickup_ts) AS INT) AS pickup_hour, count(*) AS trips, true AS within_bound
        FROM trips_geo WHERE {SECONDS_SQL} > 0 AND {NON_ZERO_SQL} AND {BOUNDS_SQL} GROUP BY 1""",
    _GEO,
)
def _p90_rate(t: Inputs):
    rows = profile_rows(t["trips_geo"], ALL_HOURS)
    found = _p90_km(settle(sampling.rate_sample(rows), "rate_sample"))
    return within_sample_size(found, rows, "pickup_hour", sampling.SAMPLE_RATE)


@register(
    "p90_hash_sample",
    f"""SELECT CAST(hour(pickup_ts) AS INT) AS pickup_hour, count(*) AS sampled,
               quantile_disc(round({KM_SQL}, 6), 0.9) AS p90_km
        FROM trips_geo
        WHERE {SECONDS_SQL} > 0 AND {NON_ZERO_SQL} AND {BOUNDS_SQL} AND {_SAMPLED} GROUP BY 1""",
    _GEO,
)
def _p90_hash(t: Inputs):
    rows = profile_rows(t["trips_geo"], ALL_HOURS, keep=("trip_id",))
    return _p90_km(settle(sampling.hash_sample(rows, F.col("trip_id"), 50), "hash_sample"))


_TOP_TRIPS = """
WITH placed AS (
  SELECT pu_location_id, trip_id, total_amount, CAST(row_number() OVER (
    PARTITION BY pu_location_id ORDER BY total_amount DESC, trip_id) AS INT) AS rn FROM trips_zone)
SELECT * FROM placed WHERE rn <= 14
"""


def _order():
    return [F.desc("total_amount"), F.asc("trip_id")]


@register("topk_per_group", _TOP_TRIPS, _ZONE)
def _topk(t: Inputs):
    df = t["trips_zone"].select("pu_location_id", "trip_id", "total_amount")
    return ranking.topk_per_group(df, ["pu_location_id"], _order(), 14)


@register("topk_two_level", _TOP_TRIPS, _ZONE)
def _topk_two_level(t: Inputs):
    df = t["trips_zone"].select("pu_location_id", "trip_id", "total_amount")
    return ranking.topk_two_level(df, ["pu_location_id"], _order(), F.col("trip_id"), 14)


@register(
    "topk_collect",
    """WITH daily AS (SELECT vendor_id, CAST(pickup_ts AS DATE) AS pickup_date,
                             round(sum(total_amount), 4) AS revenue
                      FROM trips_zone GROUP BY 1, 2),
            placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY vendor_id
                         ORDER BY revenue DESC, pickup_date) AS INT) AS rn FROM daily)
       SELECT * FROM placed WHERE rn <= 14""",
    _ZONE,
)
def _topk_collect(t: Inputs):
    daily = t["trips_zone"].groupBy(
        "vendor_id", F.to_date("pickup_ts").alias("pickup_date")
    ).agg(F.round(F.sum("total_amount"), 4).alias("revenue"))
    return ranking.topk_dates_collected(daily, "vendor_id", "pickup_date", "revenue", 14)


@register(
    "global_topk",
    """SELECT trip_id, total_amount FROM trips_zone ORDER BY total_amount DESC, trip_id LIMIT 14""",
    _ZONE,
)
def _global(t: Inputs):
    return ranking.global_topk(t["trips_zone"].select("trip_id", "total_amount"), _order(), 14)
