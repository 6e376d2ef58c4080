from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tripflow.functions import (
    duration_minutes,
    haversine_arrow_udf,
    haversine_km,
    haversine_udf,
    hour_in_zone,
    imbalance,
    normalise_iso,
    null_to_zero,
    parse_timestamp,
    safe_ratio,
    tolerant_double,
    tolerant_int,
)
from tripflow.operators.filters import valid_coordinates

CORNERS = ["lat1", "lon1", "lat2", "lon2"]


@pytest.fixture
def points(spark):
    data = [
        (1, 40.7, -74.0, 40.8, -73.9),
        (2, 1.0, 1.0, 1.0, 1.0),
        (3, 10.0, 20.0, -10.0, -160.0),  # antipodal
        (4, 90.0, 5.0, -90.0, 5.0),
        (5, 0.0, 5.0, 10.0, 5.0),
        (6, None, 5.0, 10.0, 5.0),
    ]
    return spark.createDataFrame(data, "id int, lat1 double, lon1 double, lat2 double, lon2 double")


def test_distances(points):
    km = haversine_km(*map(F.col, CORNERS))
    got = {r.id: r.km for r in points.select("id", km.alias("km")).collect()}
    assert got[2] == 0.0
    assert got[3] == pytest.approx(math.pi * 6371.0)
    assert got[4] == pytest.approx(math.pi * 6371.0)
    assert 13.8 < got[1] < 14.1
    assert got[6] is None


def test_python_forms_agree_and_guard_zero(points):
    args = [F.col(c) for c in CORNERS]
    got = points.select(
        "id",
        haversine_km(*args).alias("expr"),
        haversine_udf(*args).alias("row"),
        haversine_arrow_udf(*args).alias("arrow"),
    ).collect()
    for r in got:
        if r.id in (5, 6):
            assert r.row is None and r.arrow is None
        else:
            assert r.row == pytest.approx(r.expr, abs=1e-9)
            assert r.arrow == pytest.approx(r.expr, abs=1e-9)


def test_valid_coordinates(spark):
    data = [(90.0, 180.0), (-90.0, -180.0), (0.0, 5.0), (5.0, 0.0), (90.1, 5.0), (5.0, 180.5),
            (None, 5.0)]
    df = spark.createDataFrame(data, "a double, b double")
    assert df.where(valid_coordinates([("a", "b")])).count() == 2
    assert df.where(valid_coordinates([("a", "b")], bounds=False)).count() == 4


def test_duration(spark):
    base = dt.datetime(2015, 1, 1, 12, 0, 0)
    data = [(base, base + dt.timedelta(seconds=s)) for s in (0, 90, -60)]
    df = spark.createDataFrame(data, "a timestamp_ntz, b timestamp_ntz")
    got = [r[0] for r in df.select(duration_minutes(F.col("a"), F.col("b"))).collect()]
    assert got == [0.0, 1.5, -1.0]


def test_iso_text(spark):
    stamp = dt.datetime(2015, 1, 15, 19, 5, 39)
    texts = {
        "2015-01-15 19:05:39": stamp,
        "2015-01-15T19:05:39": stamp,
        "2015-01-15T19:05:39.123": stamp.replace(microsecond=123000),
        "2015-01-15 19:05:39.123456": stamp.replace(microsecond=123456),
        "2015-01-15T19:05:39.250-05:00": stamp.replace(day=16, hour=0, microsecond=250000),
        "2015-01-15T19:05:39Z": stamp,
        "2015-01-15 19:05:39+0130": stamp.replace(hour=17, minute=35),
        "2015-01-15 19:05:39junk": None,
        "2015-01-15T19:05:39+00:00": stamp,
        "2015-02-30 19:05:39": None,
        "2015-01-15": None,
        "": None,
        "x": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r[0]: r[1] for r in df.select("t", normalise_iso(F.col("t"))).collect()}
    assert got == texts


def test_offsets_in_a_named_zone_and_as_wall_clock(spark):
    df = spark.createDataFrame([("2024-07-01T12:00:00+02:00",), ("2024-07-01T12:00:00",)], "t string")
    zoned = normalise_iso(F.col("t"), zone="America/New_York")
    read = df.select(zoned, normalise_iso(F.col("t"), wall_clock=True)).collect()
    noon = dt.datetime(2024, 7, 1, 12)
    assert [tuple(r) for r in read] == [(noon.replace(hour=6), noon), (noon, noon)]


def test_distances_of_nan_and_null(spark):
    nan = float("nan")
    rows = [(nan, 1.0, 2.0, 3.0), (1.0, 1.0, nan, 3.0), (None, 1.0, 2.0, 3.0), (1.0, 2.0, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    forms = [f(*[F.col(c) for c in "abcd"]) for f in (haversine_km, haversine_udf, haversine_arrow_udf)]
    for r in df.select(*forms).collect():
        assert len({v if v is None else round(v, 6) for v in r}) == 1
    assert [r[0] is None for r in df.select(forms[0]).collect()] == [True, True, True, False]


def test_pattern_text(spark):
    data = [("2024-01-15T19:05:39.250",), ("2024-01-15 19:05:39",), ("2024-02-30T00:00:00.000",)]
    df = spark.createDataFrame(data, "t string")
    got = [r[0] for r in df.select(parse_timestamp(F.col("t"))).collect()]
    assert got == [dt.datetime(2024, 1, 15, 19, 5, 39, 250000), None, None]


def test_hour_in_zone_leaves_the_session_alone(spark):
    data = [(dt.datetime(2024, 1, 1, 3),), (dt.datetime(2024, 7, 1, 3),)]
    df = spark.createDataFrame(data, "t timestamp_ntz")
    got = [r[0] for r in df.select(hour_in_zone(F.col("t"), "America/New_York")).collect()]
    assert got == [22, 23]


def test_tolerant_numbers(spark):
    df = spark.createDataFrame([("7",), ("7.5",), ("x",), ("",), (None,)], "t string")
    got = df.select(tolerant_int(F.col("t")), tolerant_double(F.col("t"))).collect()
    assert [r[0] for r in got] == [7, None, None, None, None]
    assert [r[1] for r in got] == [7.0, 7.5, None, None, None]


def test_guarded_ratios(spark):
    df = spark.createDataFrame([(6.0, 3.0), (1.0, 0.0), (None, 2.0)], "a double, b double")
    got = [r[0] for r in df.select(safe_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [2.0, None, None]
    assert [r[0] for r in df.select(null_to_zero(F.col("a"))).collect()] == [6.0, 1.0, 0.0]


def test_imbalance(spark):
    df = spark.createDataFrame([(10, 0), (0, 10), (3, 2), (0, 0)], "a long, b long")
    got = [r[0] for r in df.select(imbalance(F.col("a"), F.col("b"))).collect()]
    assert got == [10.0, 10.0, 1.5, 0.0]
