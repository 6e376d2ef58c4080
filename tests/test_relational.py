from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tripflow import TripWindow
from tripflow.operators.aggregates import avg_where, mean_by_join, share_where, two_level_mean
from tripflow.operators.joins import broadcast_if_small, full_outer_merge, lookup
from tripflow.operators.ranking import (
    global_topk,
    topk_dates_collected,
    topk_per_group,
    topk_two_level,
)
from tripflow.plans import best_days, hourly_profile
from tripflow.plans.card_use import card_use
from tripflow.plans.revenue_share import revenue_share
from tripflow.plans.zone_balance import zone_imbalance, zone_imbalance_merged

W = TripWindow()
NOON = dt.datetime(2024, 1, 11, 12)
ZONES = "location_id int, borough string, zone string, service_zone string"


@pytest.fixture
def few_zones(spark):
    data = [(1, "A", "a", "S"), (2, "B", "b", "S"), (3, None, "c", None)]
    return spark.createDataFrame(data, ZONES)


def test_ties_at_rank_k_go_by_date(spark, rows):
    days = [dt.date(2024, 1, d) for d in (5, 3, 4, 1)]
    df = spark.createDataFrame([(1, d, 2.0) for d in days] + [(2, days[0], 1.0)],
                               "g int, d date, m double")
    order = [F.desc("m"), F.asc("d")]
    want = [(1, dt.date(2024, 1, 1)), (1, dt.date(2024, 1, 3)), (2, dt.date(2024, 1, 5))]
    assert rows(topk_per_group(df, ["g"], order, 2), "g", "d") == want
    assert rows(topk_two_level(df, ["g"], order, F.col("d"), 2, buckets=3), "g", "d") == want
    assert rows(topk_dates_collected(df, "g", "d", "m", 2), "g", "d") == want


def test_two_level_topk_of_one_hot_group(spark, rows):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 5).otherwise(F.lit(9)).alias("g"),
        (F.col("id") * 7919 % 5003).alias("m"),
        "id",
    )
    order = [F.desc("m"), F.asc("id")]
    assert rows(topk_two_level(df, ["g"], order, F.col("id"), 7)) == rows(
        topk_per_group(df, ["g"], order, 7)
    )


def test_global_topk(spark):
    df = spark.range(100)
    assert [r.id for r in global_topk(df, [F.desc("id")], 3).collect()] == [99, 98, 97]


def test_null_keys_of_a_full_merge_stay_apart(spark, rows):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, l long")
    right = spark.createDataFrame([("b", 3), (None, 4)], "k string, r long")
    assert rows(full_outer_merge(left, right, ["k"], ["l", "r"])) == [
        ("a", 1, 0), ("b", 0, 3), (None, 0, 4), (None, 2, 0),
    ]


def test_broadcast_only_below_the_bound(spark, plan):
    big = spark.range(0, 1000, 1, 8).withColumnRenamed("id", "k")
    assert "ResolvedHint" in plan(broadcast_if_small(big, max_rows=1000), "extended")
    assert "ResolvedHint" not in plan(broadcast_if_small(big, max_rows=999), "extended")
    assert "ResolvedHint" not in plan(broadcast_if_small(big, max_bytes=100), "extended")


def test_lookup_of_missing_and_null_keys(spark, rows, few_zones):
    trips = spark.createDataFrame([(1, 1), (2, 99), (3, None)], "id int, loc int")
    assert rows(lookup(trips, few_zones, "loc", take={"zone": "z"}), "id", "z") == [(1, "a")]
    left = lookup(trips, few_zones, "loc", take={"zone": "z"}, how="left")
    assert rows(left, "id", "z") == [(1, "a"), (2, None), (3, None)]


def test_conditional_means(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None), (2, 8.0), (None, 9.0)], "p int, x double")
    share, mean, none = df.agg(
        share_where(F.col("p") == 1), avg_where(F.col("p") == 1, F.col("x")),
        avg_where(F.col("p") == 5, F.col("x")),
    ).first()
    assert (share, mean, none) == (0.5, 2.0, None)


def test_mean_by_join_keeps_the_null_group(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0)], "k string, v double")
    assert rows(mean_by_join(df, ["k"], "v")) == [("a", 2, 2.0), (None, 1, 5.0)]


def test_means_in_three_shapes(zone_trips):
    df = zone_trips.withColumn("h", F.hour("pickup_ts"))
    plain = {r.h: r.m for r in df.groupBy("h").agg(F.avg("total_amount").alias("m")).collect()}
    for other in (
        two_level_mean(df, ["h"], F.dayofmonth("pickup_ts"), "total_amount"),
        mean_by_join(df, ["h"], "total_amount"),
    ):
        assert {r.h: r.mean for r in other.collect()} == pytest.approx(plain)


TRIP = (
    "vendor_id int, pickup_ts timestamp_ntz, pu_location_id int, do_location_id int, "
    "payment_type int, fare_amount double, tip_amount double, total_amount double, "
    "congestion_surcharge double, airport_fee double"
)


@pytest.fixture
def few_trips(spark):
    data = [
        (1, NOON, 1, 2, 1, 10.0, 1.0, 12.0, 2.5, None),
        (1, NOON, 1, 99, 1, 0.0, 1.0, None, None, None),
        (1, NOON, 98, 2, 2, 10.0, 0.0, 0.0, None, 1.75),
        (None, NOON, 2, 1, 2, 10.0, 0.0, 0.0, None, 1.75),
        (2, NOON, 3, 3, None, 5.0, 0.5, 6.0, 0.0, 0.0),
        (1, dt.datetime(2024, 1, 14, 12), 1, 2, 1, 10.0, 1.0, 12.0, 2.5, None),
        (1, dt.datetime(2024, 1, 11, 15), 1, 2, 1, 10.0, 1.0, 12.0, 2.5, None),
        (1, None, 1, 2, 1, 10.0, 1.0, 12.0, 2.5, None),
    ]
    return spark.createDataFrame(data, TRIP)


def test_card_use_edges(few_trips, few_zones, rows):
    got = rows(card_use(few_trips, few_zones, W))
    assert got == sorted([("A", 2, 1.0, 0.1), ("B", 1, 0.0, None), (None, 1, 0.0, None)], key=str)


def test_revenue_edges(few_trips, few_zones, rows):
    got = {r[:2]: r[2:] for r in rows(revenue_share(few_trips, few_zones, W))}
    assert got[(1, "S")] == (2, 12.0, 2.5, 2.5 / 12.0, 6.0)
    assert got[(None, "S")] == (1, 0.0, 1.75, 0.0, 0.0)  # no revenue: share 0
    assert got[(2, None)] == (1, 6.0, 0.0, 0.0, 6.0)


def test_unmatched_zones_stay_two_rows(few_trips, few_zones, rows):
    one_scan = rows(zone_imbalance(few_trips, few_zones, W))
    assert one_scan == rows(zone_imbalance_merged(few_trips, few_zones, W))
    unknown = [r[2:4] for r in one_scan if r[0] is None and r[1] is None]
    assert sorted(unknown) == [(0, 1), (1, 0)]
    half_known = [r[2:4] for r in one_scan if r[1] == "c"]
    assert sorted(half_known) == [(0, 1), (1, 0)]


def rounded(df, digits=9):
    return [
        tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.collect()
    ]


@pytest.mark.parametrize("window", [W, TripWindow(hour_start=22), TripWindow(0, 24)])
def test_profile_forms_agree(geo, window):
    base = rounded(hourly_profile.hourly_profile(geo, window))
    assert [r[0] for r in base] == sorted(window.hours)
    assert rounded(hourly_profile.hourly_profile_sql(geo, window)) == base
    assert rounded(hourly_profile.hourly_profile(geo, window, write_rows=False)) == base
    sampled = hourly_profile.hourly_profile_sampled(geo, window)
    # So few trips an hour that the sample holds all.
    assert rounded(sampled.drop("sampled", "rank_error")) == base
    sketch = hourly_profile.hourly_profile_approx(geo, window, accuracy=1_000_000)
    assert rounded(sketch, 6) == rounded(hourly_profile.hourly_profile(geo, window), 6)


@pytest.mark.parametrize("window", [W, TripWindow(hour_start=22, top_k=3)])
def test_best_day_forms_agree(geo, window):
    base = rounded(best_days.best_days(geo, window))
    assert base
    for other in (
        best_days.best_days_sql,
        best_days.best_days_two_level,
        best_days.best_days_collected,
    ):
        assert rounded(other(geo, window)) == base
