"""The physical plans that make the jobs hold at scale."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tripflow import TripWindow
from tripflow.catalog.inputs import layout_by_day_hour
from tripflow.functions.geo import haversine_arrow_udf, haversine_udf
from tripflow.operators.filters import positive
from tripflow.operators.ranking import global_topk, topk_per_group
from tripflow.plans import best_days, hourly_profile
from tripflow.plans.card_use import card_use, card_use_sql
from tripflow.plans.flows import borough_flows
from tripflow.plans.revenue_share import revenue_share
from tripflow.plans.zone_balance import zone_imbalance, zone_imbalance_merged

W = TripWindow()


@pytest.fixture(scope="module")
def geo_table(spark, geo, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("geo") / "t")
    geo.write.parquet(path)
    return spark.read.parquet(path)


def test_scan_reads_only_needed_columns_and_pushes_plain_filters(geo_table, plan):
    text = plan(geo_table.where(positive("trip_distance", "fare_amount")).select("tip_amount"))
    assert "ReadSchema: struct<trip_distance:double,fare_amount:double,tip_amount:double>" in text
    assert "GreaterThan(trip_distance,0.0)" in text


def test_profile_broadcasts_hours_only_and_stays_out_of_python(geo_table, plan):
    text = plan(hourly_profile.hourly_profile(geo_table, W, write_rows=False))
    assert "BroadcastHashJoin" in text
    assert "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text
    assert text.count("FileScan") == 2
    assert "trip_distance" not in text  # not a column this job needs


def test_written_profile_scans_a_narrow_table(geo_table, plan):
    text = plan(hourly_profile.hourly_profile(geo_table, W))
    assert "pickup_latitude" not in text


def test_udf_forms_go_through_python_once(geo_table, plan):
    rows = hourly_profile.profile_rows
    assert "ArrowEvalPython" in plan(rows(geo_table, W, distance=haversine_udf))
    assert "ArrowEvalPython" in plan(rows(geo_table, W, distance=haversine_arrow_udf))
    written = hourly_profile.hourly_profile(geo_table, W, distance=haversine_arrow_udf)
    assert "Python" not in plan(written)


def test_topk_is_cut_before_the_shuffle(zone_trips, plan):
    order = [F.desc("total_amount"), F.asc("trip_id")]
    assert "WindowGroupLimit" in plan(topk_per_group(zone_trips, ["pu_location_id"], order, 5))
    assert "TakeOrderedAndProject" in plan(global_topk(zone_trips, order, 5))


def test_best_days_forms(geo, plan):
    assert "WindowGroupLimit" in plan(best_days.best_days(geo, W))
    assert plan(best_days.best_days_two_level(geo, W)).count("WindowGroupLimit") >= 3


@pytest.mark.parametrize("job", [card_use, borough_flows, revenue_share, zone_imbalance])
def test_trips_are_counted_before_they_meet_a_join(job, zone_trips, zones, plan):
    """The trip scan is the deepest, and a partial aggregate lies between it and any join."""
    text = plan(job(zone_trips, zones, W, strategy="merge"))
    assert "SortMergeJoin" in text and "Python" not in text
    lines = text.splitlines()
    scans = [i for i, line in enumerate(lines) if "FileScan" in line and "user_id" in line]
    assert len(scans) == 1
    above = lines[: scans[0]]
    last_join = max(i for i, line in enumerate(above) if "SortMergeJoin" in line)
    assert any("partial_count" in line for line in above[last_join:])


def test_join_strategies_differ_in_plan_and_agree_in_rows(zone_trips, zones, plan, rows):
    broadcast = zone_imbalance_merged(zone_trips, zones, W, "broadcast")
    merge = zone_imbalance_merged(zone_trips, zones, W, "merge")
    # Two lookups by strategy; the full join of the two aggregates is a sort-merge either way,
    # and the zones view itself joins two tiny tables.
    assert plan(broadcast).count("SortMergeJoin") == 1
    assert plan(merge).count("SortMergeJoin") == 3
    assert rows(broadcast) == rows(merge)


@pytest.mark.parametrize("job", ["flows", "cards", "cards_sql", "imbalance", "broadcast", "merge", "revenue"])
def test_zone_jobs_prune_the_layout(inputs, plan, job):
    laid_out, zones = layout_by_day_hour(inputs), inputs["zones"]
    df = {
        "flows": lambda: borough_flows(laid_out, zones, W),
        "cards": lambda: card_use(laid_out, zones, W),
        "cards_sql": lambda: card_use_sql(laid_out, zones, W),
        "imbalance": lambda: zone_imbalance(laid_out, zones, W),
        "broadcast": lambda: zone_imbalance_merged(laid_out, zones, W, "broadcast"),
        "merge": lambda: zone_imbalance_merged(laid_out, zones, W, "merge"),
        "revenue": lambda: revenue_share(laid_out, zones, W),
    }[job]()
    text = plan(df)
    assert "PartitionFilters: [pickup_day" in text and "dayofmonth" not in text


def test_join_strategies_without_broadcast_and_adaptive_execution(spark, inputs, plan):
    """The second run of the comparison: no broadcast by threshold, no plan changed at run time."""
    trips, zones = inputs["trips_zone"], inputs["zones"]
    expected = zone_imbalance(trips, zones, W).collect()
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        for strategy, join in (("merge", "SortMergeJoin"), ("auto", "SortMergeJoin"), ("broadcast", "BroadcastHashJoin")):
            df = zone_imbalance_merged(trips, zones, W, strategy)
            text = plan(df)
            assert join in text and "AdaptiveSparkPlan" not in text
            assert df.collect() == expected
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
