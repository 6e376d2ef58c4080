"""Sinks and table layouts: each query writes all rows and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripflow.catalog.inputs import STAMPS, by_date, calendar, geo_csv, layout_by_day_hour
from tripflow.catalog.registry import register, rounded
from tripflow.catalog.views import Inputs
from tripflow.functions.times import ISO_MICROS_PATTERN, normalise_iso
from tripflow.operators.filters import on_dates
from tripflow.operators.joins import on_calendar
from tripflow.schemas import GEO_FILE_SCHEMA
from tripflow.sources.readers import read_csv_typed
from tripflow.sources.single_file import export_one_csv
from tripflow.sources.staging import written_once
from tripflow.sources.writers import csv_to_parquet, export_csv, finished_files, load_by_date, loaded

# Test parameters: three days of the month that the test tables cover.
DATES = ["2024-01-09", "2024-01-10", "2024-01-11"]
DATES_SQL = "(DATE '2024-01-09', DATE '2024-01-10', DATE '2024-01-11')"


def _converted(t: Inputs) -> str:
    return written_once(
        t.spark,
        "geo_parquet",
        t.sf_dir,
        lambda out: csv_to_parquet(t.spark, geo_csv(t), out, GEO_FILE_SCHEMA),
    )


@register("convert_csv_to_parquet", "SELECT * FROM geo_file", ("geo_file",))
def _convert(t: Inputs):
    return t.spark.read.parquet(_converted(t))


@register(
    "write_partition_day_hour",
    """SELECT CAST(day(pickup_ts) AS INT) AS pickup_day,
              CAST(hour(pickup_ts) AS INT) AS pickup_hour, count(*) AS trips,
              round(sum(total_amount), 4) AS total
       FROM trips_zone GROUP BY 1, 2""",
    ("trips_zone",),
)
def _day_hour(t: Inputs):
    counted = layout_by_day_hour(t).groupBy("pickup_day", "pickup_hour").agg(
        F.count("*").alias("trips"), F.sum("total_amount").alias("total")
    )
    return rounded(counted, total=4)


_BY_DATE = """SELECT CAST(pickup_ts AS DATE) AS pickup_date, count(*) AS trips,
       round(sum(total_amount), 4) AS total
FROM trips_zone {where} GROUP BY 1"""


def _per_date(df):
    counted = df.groupBy("pickup_date").agg(
        F.count("*").alias("trips"), F.sum("total_amount").alias("total")
    )
    return rounded(counted, total=4)


@register("write_partition_date", _BY_DATE.format(where=""), ("trips_zone",))
def _date(t: Inputs):
    return _per_date(t.spark.read.parquet(by_date(t)))


@register(
    "write_partition_date_subset",
    _BY_DATE.format(where=f"WHERE CAST(pickup_ts AS DATE) IN {DATES_SQL}"),
    ("trips_zone",),
)
def _date_subset(t: Inputs):
    return _per_date(t.spark.read.parquet(by_date(t, DATES)))


def repeated_loads(t: Inputs) -> str:
    """All dates without every fifth trip, then three dates again with those that came late."""

    def write(out: str) -> None:
        load_by_date(t["trips_zone"].where("trip_id % 5 <> 0"), out, "first")
        load_by_date(t["trips_zone"].where(on_dates(F.to_date("pickup_ts"), DATES)), out, "late")

    return written_once(t.spark, "loads", t.sf_dir, write)


@register(
    "repeated_loads",
    _BY_DATE.format(where=f"WHERE trip_id % 5 <> 0 OR CAST(pickup_ts AS DATE) IN {DATES_SQL}"),
    ("trips_zone",),
)
def _repeated(t: Inputs):
    return _per_date(loaded(t.spark, repeated_loads(t)))


@register(
    "finished_files",
    f"""SELECT CAST(pickup_ts AS DATE) AS pickup_date, count(*) AS rows,
               CASE WHEN CAST(pickup_ts AS DATE) IN {DATES_SQL} THEN 'late' ELSE 'first' END AS load
        FROM trips_zone WHERE trip_id % 5 <> 0 OR CAST(pickup_ts AS DATE) IN {DATES_SQL} GROUP BY 1""",
    ("trips_zone",),
)
def _finished(t: Inputs):
    """The list of files against what they hold."""
    return finished_files(t.spark, repeated_loads(t)).groupBy("pickup_date", "load").agg(F.sum("rows").alias("rows"))


@register(
    "calendar_pruned_scan",
    """SELECT CAST(pickup_ts AS DATE) AS pickup_date, CAST(isodow(pickup_ts) AS INT) AS weekday, count(*) AS trips,
              round(sum(total_amount), 4) AS total
       FROM trips_zone WHERE isodow(pickup_ts) >= 6 GROUP BY 1, 2""",
    ("trips_zone",),
)
def _calendar(t: Inputs):
    """Trips of weekends, by a calendar that is joined."""
    weekends = on_calendar(t.spark.read.parquet(by_date(t)), calendar(t), F.col("weekday") >= 6)
    counted = weekends.groupBy("pickup_date", "weekday").agg(F.count("*").alias("trips"), F.sum("total_amount").alias("total"))
    return rounded(counted, total=4)


@register("csv_export_roundtrip", "SELECT * FROM geo_file", ("geo_file",))
def _roundtrip(t: Inputs):
    path = written_once(
        t.spark,
        "geo_export",
        t.sf_dir,
        lambda out: export_csv(t.spark.read.parquet(_converted(t)), out, ISO_MICROS_PATTERN, compression="gzip"),
    )
    df = read_csv_typed(t.spark, path, GEO_FILE_SCHEMA)
    return df.withColumns({name: normalise_iso(F.col(name)) for name in STAMPS})


@register(
    "pruned_count",
    f"""SELECT count(*) AS trips FROM trips_zone
        WHERE CAST(pickup_ts AS DATE) IN {DATES_SQL} AND hour(pickup_ts) BETWEEN 11 AND 14""",
    ("trips_zone",),
)
def _pruned_count(t: Inputs):
    df = t.spark.read.parquet(by_date(t))
    return df.where(
        on_dates(F.col("pickup_date"), DATES) & F.hour("pickup_ts").between(11, 14)
    ).agg(F.count("*").alias("trips"))


@register("csv_one_file_roundtrip", "SELECT * FROM geo_file", ("geo_file",))
def _one_file(t: Inputs):
    """One file with one header, written by many tasks in the order of pickups, and read back."""
    order = ["tpep_pickup_datetime", "tpep_dropoff_datetime", "total_amount"]
    path = written_once(
        t.spark, "geo_one_file.csv", t.sf_dir, lambda out: export_one_csv(t.spark.read.parquet(_converted(t)), out, order)
    )
    df = read_csv_typed(t.spark, path, GEO_FILE_SCHEMA)
    return df.withColumns({name: normalise_iso(F.col(name)) for name in STAMPS})
