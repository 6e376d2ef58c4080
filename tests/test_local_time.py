"""Windows of a named zone over the layout in UTC."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tripflow import TripWindow
from tripflow.catalog.inputs import layout_by_day_hour
from tripflow.operators.filters import in_window, prune_to_local, utc_folders, utc_offsets
from tripflow.sources.writers import write_by_day_hour

ZONES = ["America/New_York", "Asia/Kathmandu", "Asia/Tokyo", "Pacific/Chatham", "Pacific/Kiritimati", "Australia/Lord_Howe", "UTC"]
WINDOWS = [
    {}, {"day_start": 1, "day_count": 1, "hour_start": 0, "hour_count": 2},
    {"day_start": 31, "day_count": 1, "hour_start": 22, "hour_count": 2}, {"day_start": 28, "day_count": 2, "hour_start": 20},
]


@pytest.fixture(scope="module")
def year(spark, tmp_path_factory):
    """Every half hour of a leap year and the days around it, by UTC day and hour."""
    out = str(tmp_path_factory.mktemp("year"))
    first = F.lit("2023-12-25 00:00:00").cast("timestamp_ntz")
    rows = spark.range(380 * 48).select("id", (first + F.make_dt_interval(mins=(F.col("id") * 30).cast("int"))).alias("pickup_ts"))
    write_by_day_hour(rows, out)
    return spark.read.parquet(out)


@pytest.mark.parametrize("zone", ZONES)
@pytest.mark.parametrize("number", range(len(WINDOWS)))
def test_no_time_is_lost(spark, year, zone, number):
    window = TripWindow(zone=zone, **WINDOWS[number])
    pruned = prune_to_local(year, window)
    found = {r.id for r in pruned.where(in_window(pruned, window)).select("id").collect()}
    whole = year.drop("pickup_day", "pickup_hour")
    assert found == {r.id for r in whole.where(in_window(whole, window)).select("id").collect()}
    assert found or 31 not in window.days


def test_offsets_cover_both_seasons(spark):
    assert utc_offsets(spark, "America/New_York") == [-300, -240]
    assert utc_offsets(spark, "Asia/Kathmandu") == [345]
    assert utc_offsets(spark, "UTC") == [0]
    assert utc_offsets(spark, "Pacific/Chatham") == [765, 825]


def test_folders(spark):
    window = TripWindow(day_start=11, day_count=1, hour_start=22, hour_count=1)
    assert utc_folders(window, [-300, -240]) == {12: [2, 3]}
    assert utc_folders(window, [345]) == {11: [16, 17]}
    first = TripWindow(day_start=1, day_count=1, hour_start=3, hour_count=1)
    assert utc_folders(first, [540]) == {28: [18], 29: [18], 30: [18], 31: [18]}
    last = TripWindow(day_start=30, day_count=1, hour_start=23, hour_count=1)
    assert utc_folders(last, [-300]) == {1: [4], 31: [4]}


def test_only_those_folders_are_opened(spark, inputs, plan):
    window = TripWindow(zone="America/New_York")
    pruned = prune_to_local(layout_by_day_hour(inputs), window)
    kept = pruned.where(in_window(pruned, window))
    text = plan(kept, "formatted")
    assert re.search(r"PartitionFilters: \[.*pickup_day", text)
    files = kept.select(F.input_file_name().alias("f")).distinct().collect()
    opened = {tuple(map(int, re.search(r"pickup_day=(\d+)/pickup_hour=(\d+)", r.f).groups())) for r in files}
    wanted = {(d, h) for d, hours in utc_folders(window, [-300, -240]).items() for h in hours}
    assert opened and opened <= wanted and len(wanted) == 15
    # Local 11 to 14 is 15 to 18 UTC in summer and 16 to 19 in winter.
    assert wanted == {(d, h) for d in (11, 12, 13) for h in range(15, 20)}
