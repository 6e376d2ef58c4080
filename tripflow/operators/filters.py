"""Row filters, each a Column to hand to ``where``.

Hour-of-day and day-of-month tests cannot be pushed into a Parquet scan (only the not-null part
can), which is why tables are laid out by day and hour: ``in_window`` prunes on those layout
columns when the frame has them and falls back to the timestamp when it does not.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date
from functools import lru_cache, reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripflow.params import TripWindow


def _all(conditions: Iterable[Column]) -> Column:
    return reduce(and_, conditions)


def local_time(ts: Column, window: TripWindow) -> Column:
    """Wall-clock time in the window's zone, if it names one."""
    if window.zone is None:
        return ts
    return F.convert_timezone(F.lit("UTC"), F.lit(window.zone), ts)


def in_hours(ts: Column, window: TripWindow) -> Column:
    return F.hour(local_time(ts, window)).isin(window.hours)


def on_days(ts: Column, window: TripWindow) -> Column:
    return F.dayofmonth(local_time(ts, window)).isin(window.days)


def in_window(df: DataFrame, window: TripWindow, ts: str = "pickup_ts") -> Column:
    """Day and hour test of a zone-layout frame, on layout columns where it has them.

    A layout must have been written for the zone that the window names (``write_by_day_hour``); one
    in UTC goes through ``prune_to_local`` first.
    """
    if {"pickup_day", "pickup_hour"} <= set(df.columns):
        return F.col("pickup_day").isin(window.days) & F.col("pickup_hour").isin(window.hours)
    return on_days(F.col(ts), window) & in_hours(F.col(ts), window)


#: Years whose offsets count. Fixed value: no trip record is older, and no rule reaches further ahead.
_OFFSET_YEARS = (2000, 2100)


def utc_offsets(spark: SparkSession, zone: str) -> list[int]:
    """Minutes that a named zone is ahead of UTC, every value it takes at any time of the years above.

    Spark's own rules are asked, with one row an hour of those years, so that this agrees with the
    filters that it shall prune for.
    """
    return list(_offsets(spark.conf.get("spark.app.id", ""), zone))


@lru_cache(maxsize=256)
def _offsets(app: str, zone: str) -> tuple[int, ...]:
    spark = SparkSession.getActiveSession()
    first, last = (F.lit(f"{year}-01-01 00:00:00").cast("timestamp_ntz") for year in _OFFSET_YEARS)
    hours = (_OFFSET_YEARS[1] - _OFFSET_YEARS[0]) * 366 * 24
    utc = first + F.make_dt_interval(hours=F.col("id").cast("int"))
    times = spark.range(0, hours, 1, 8).select(utc.alias("utc")).where(F.col("utc") < last)
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("utc"))
    ahead = F.timestamp_diff("MINUTE", F.col("utc"), local)
    return tuple(sorted(r[0] for r in times.select(ahead.alias("m")).distinct().collect()))


def utc_folders(window: TripWindow, offsets: Iterable[int]) -> dict[int, list[int]]:
    """Hours by day of the month, in UTC, that can hold a time of the window's local days and hours.

    A local hour lies in one UTC hour for each offset of whole hours, in two for others. It may lie in
    the day before or after; before the 1st comes any last day of a month, after such a day the 1st.
    """
    found: set[tuple[int, int]] = set()
    for day in window.days:
        for hour in window.hours:
            for offset in offsets:
                for minute in (hour * 60 - offset, hour * 60 - offset + 59):
                    shift, utc_hour = minute // 1440, minute % 1440 // 60
                    moved = {day + shift}
                    if day + shift < 1:
                        moved = {last + day + shift for last in (28, 29, 30, 31)}
                    elif shift > 0:
                        moved |= {day + shift - last for last in (28, 29, 30, 31) if day <= last < day + shift}
                    found |= {(d, utc_hour) for d in moved if d <= 31}
    return {d: sorted(h for e, h in found if e == d) for d in sorted({d for d, _ in found})}


def prune_to_local(df: DataFrame, window: TripWindow) -> DataFrame:
    """Of a layout by UTC day and hour only the folders that can hold the window's local times.

    The layout's columns are dropped, so that ``in_window`` then tests each time itself: the folders
    are those of every offset that the zone ever has, summer and winter.
    """
    folders = utc_folders(window, utc_offsets(df.sparkSession, window.zone or "UTC"))
    # One list of hours for all days that have the same, so that the test stays short.
    alike: dict[tuple[int, ...], list[int]] = {}
    for day, hours in folders.items():
        alike.setdefault(tuple(hours), []).append(day)
    wanted = [F.col("pickup_day").isin(days) & F.col("pickup_hour").isin([*hours]) for hours, days in alike.items()]
    return df.where(reduce(or_, wanted)).drop("pickup_day", "pickup_hour")


def on_dates(day: Column, dates: Iterable[str]) -> Column:
    """Calendar-date list; the text is turned into date literals here, so it can prune."""
    return day.isin([date.fromisoformat(text) for text in dates])


def present(*columns: str) -> Column:
    return _all(F.col(name).isNotNull() for name in columns)


def positive(*columns: str) -> Column:
    return _all(F.col(name) > 0 for name in columns)


def valid_coordinates(
    points: Iterable[tuple[str, str]] = (
        ("pickup_latitude", "pickup_longitude"),
        ("dropoff_latitude", "dropoff_longitude"),
    ),
    bounds: bool = True,
) -> Column:
    """Every (latitude, longitude) non-zero and, with ``bounds``, on the globe. Null fails."""
    tests = []
    for lat, lon in points:
        tests += [F.col(lat) != 0, F.col(lon) != 0]
        if bounds:
            tests += [F.col(lat).between(-90.0, 90.0), F.col(lon).between(-180.0, 180.0)]
    return _all(tests)
