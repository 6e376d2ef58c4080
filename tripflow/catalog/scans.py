"""Scans and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripflow.catalog.inputs import STAMPS, geo_csv, layout_by_day_hour, trip_lines, zone_csv
from tripflow.catalog.registry import register
from tripflow.catalog.views import Inputs
from tripflow.functions.times import ISO_MICROS_PATTERN, normalise_iso, parse_timestamp
from tripflow.functions.values import tolerant_double, tolerant_int
from tripflow.operators.filters import in_window
from tripflow.params import TripWindow
from tripflow.schemas import (
    AIRPORT_FEE_NAMES,
    GEO_FILE_SCHEMA,
    ZONE_FILE_SCHEMA,
    first_column,
)
from tripflow.sources import readers

W = TripWindow()


@register("scan_parquet", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def _scan_parquet(t: Inputs):
    return readers.read_parquet(t.spark, t.path("events"))


@register(
    "partitioned_scan",
    """SELECT vendor_id, pickup_ts,
              CAST(day(pickup_ts) AS INT) AS pickup_day,
              CAST(hour(pickup_ts) AS INT) AS pickup_hour, pu_location_id, total_amount
       FROM trips_zone WHERE day(pickup_ts) IN (11, 12, 13)
         AND hour(pickup_ts) IN (11, 12, 13, 14)""",
    ("trips_zone",),
)
def _partitioned_scan(t: Inputs):
    df = layout_by_day_hour(t)
    return df.where(in_window(df, W)).select(
        "vendor_id", "pickup_ts", "pickup_day", "pickup_hour", "pu_location_id", "total_amount"
    )


@register(
    "csv_explicit_schema",
    """SELECT * REPLACE (
         strftime(tpep_pickup_datetime, '%Y-%m-%d %H:%M:%S.%f') AS tpep_pickup_datetime,
         strftime(tpep_dropoff_datetime, '%Y-%m-%d %H:%M:%S.%f') AS tpep_dropoff_datetime)
       FROM geo_file""",
    ("geo_file",),
)
def _csv_explicit(t: Inputs):
    return readers.read_csv_typed(t.spark, geo_csv(t), GEO_FILE_SCHEMA)


@register("csv_infer_schema", "SELECT * FROM geo_file", ("geo_file",))
def _csv_inferred(t: Inputs):
    df = readers.read_csv_inferred(t.spark, geo_csv(t))
    return df.withColumns({name: F.col(name).cast("timestamp_ntz") for name in STAMPS})


@register("csv_string_late_cast", "SELECT * FROM zone_file", ("zone_file",))
def _csv_late_cast(t: Inputs):
    types = {field.name: field.dataType.simpleString() for field in ZONE_FILE_SCHEMA.fields}
    df = readers.late_cast(readers.read_csv_text(t.spark, zone_csv(t)), types)
    return df.withColumns({name: parse_timestamp(F.col(name), ISO_MICROS_PATTERN) for name in STAMPS})


@register(
    "text_line_parse",
    """WITH kept AS (SELECT * FROM zone_base WHERE trip_id % 13 <> 0 AND trip_id % 17 <> 0)
       SELECT * EXCLUDE (trip_id) REPLACE (
         CASE WHEN trip_id % 23 <> 0 THEN tolls_amount END AS tolls_amount) FROM kept""",
    ("zone_base",),
)
def _text_lines(t: Inputs):
    df = readers.read_text_lines(
        t.spark,
        trip_lines(t),
        ZONE_FILE_SCHEMA,
        required=["VendorID", *STAMPS, "trip_distance", "fare_amount", "tip_amount"],
    )
    return df.withColumns({name: normalise_iso(F.col(name)) for name in STAMPS})


@register(
    "text_line_outcomes",
    """WITH lines AS (
         SELECT CASE WHEN trip_id % 13 = 0 THEN 'too few fields' WHEN trip_id % 17 = 0 THEN 'unreadable: trip_distance'
                ELSE 'kept' END AS outcome FROM zone_base
         UNION ALL SELECT 'header' FROM zone_base WHERE trip_id % 1000 = 0)
       SELECT outcome, count(*) AS lines FROM lines GROUP BY 1""",
    ("zone_base",),
)
def _line_outcomes(t: Inputs):
    """All lines by what became of them: rows kept, and lines rejected with their reason."""
    required = ["VendorID", *STAMPS, "trip_distance", "fare_amount", "tip_amount"]
    kept, rejected = readers.split_text_lines(t.spark.read.text(trip_lines(t)), ZONE_FILE_SCHEMA, required)
    outcomes = kept.select(F.lit("kept").alias("outcome")).unionByName(rejected.select(F.col("reason").alias("outcome")))
    return outcomes.groupBy("outcome").agg(F.count("*").alias("lines"))


@register("csv_remembered_schema", "SELECT * FROM geo_file", ("geo_file",))
def _csv_remembered(t: Inputs):
    """Types inferred in one pass by the first read, and kept beside the file for this one."""
    readers.read_csv_remembered(t.spark, geo_csv(t))
    return readers.read_csv_remembered(t.spark, geo_csv(t))


@register(
    "tolerant_cast",
    """SELECT trip_id, CASE WHEN trip_id % 4 = 1 THEN CAST(trip_id AS INT) END AS as_int,
              CASE trip_id % 4 WHEN 1 THEN CAST(trip_id AS DOUBLE)
                               WHEN 2 THEN trip_id + CAST(0.5 AS DOUBLE) END AS as_double
       FROM trips_zone""",
    ("trips_zone",),
)
def _tolerant_cast(t: Inputs):
    number = F.col("trip_id").cast("string")
    text = (
        F.when(F.col("trip_id") % 4 == 0, F.lit("n/a"))
        .when(F.col("trip_id") % 4 == 1, number)
        .when(F.col("trip_id") % 4 == 2, F.concat(number, F.lit(".5")))
        .otherwise(F.lit(""))
    )
    return (
        t["trips_zone"]
        .select("trip_id", text.alias("text"))
        .select(
            "trip_id",
            tolerant_int(F.col("text")).alias("as_int"),
            tolerant_double(F.col("text")).alias("as_double"),
        )
    )


_CTES = """
WITH base AS (
  SELECT vendor_id, pickup_ts, total_amount FROM tripflow_trips WHERE pickup_ts IS NOT NULL
),
kept AS (SELECT *, hour(pickup_ts) AS h FROM base WHERE total_amount > 10)
SELECT CAST(h AS INT) AS pickup_hour, vendor_id, count(*) AS trips,
       round(sum(total_amount), 4) AS total
FROM kept GROUP BY h, vendor_id
"""


@register("sql_over_view", _CTES.replace("tripflow_trips", "trips_zone"), ("trips_zone",))
def _sql_over_view(t: Inputs):
    t["trips_zone"].createOrReplaceTempView("tripflow_trips")
    return t.spark.sql(_CTES)


@register(
    "column_fallback",
    "SELECT VendorID, PULocationID, Airport_fee AS airport_fee FROM zone_file",
    ("zone_file",),
)
def _column_fallback(t: Inputs):
    df = t["zone_file"]
    fee = first_column(df, AIRPORT_FEE_NAMES, "airport_fee")
    return df.select("VendorID", "PULocationID", fee)


_TYPES = {"VendorID": "int", "tpep_pickup_datetime": "timestamp_ntz",
          "tpep_dropoff_datetime": "timestamp_ntz", "store_and_fwd_flag": "string"} | {
    field.name: field.dataType.simpleString()
    for field in ZONE_FILE_SCHEMA.fields
    if field.name not in (*STAMPS, "VendorID", "store_and_fwd_flag")
}


@register(
    "schema_report",
    "\nUNION ALL\n".join(
        f"SELECT {position} AS position, '{name}' AS name, '{_TYPES[name]}' AS type, "
        f"count({name}) AS present FROM zone_file"
        for position, name in enumerate(ZONE_FILE_SCHEMA.fieldNames())
    ),
    ("zone_file",),
)
def _schema_report(t: Inputs):
    return readers.schema_report(t["zone_file"])


@register(
    "preview_rows",
    """SELECT pickup_ts, dropoff_ts, trip_distance, fare_amount, tip_amount FROM trips_geo
       ORDER BY pickup_ts, dropoff_ts, trip_distance, fare_amount, tip_amount LIMIT 5""",
    ("trips_geo",),
)
def _preview(t: Inputs):
    columns = ["pickup_ts", "dropoff_ts", "trip_distance", "fare_amount", "tip_amount"]
    return readers.preview_rows(t["trips_geo"], columns, [F.asc(c) for c in columns], 5)
