"""Declared layouts of the trip files, and the common column names the jobs work on.

Two file layouts exist: the older one locates a trip by coordinates, the newer one by zone ids.
``to_geo_trips`` and ``to_zone_trips`` turn either into the snake-case names used everywhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, IntegerType, StringType, StructField, StructType

_INT, _DOUBLE, _TEXT = IntegerType(), DoubleType(), StringType()


def _layout(fields: list[tuple[str, DataType]]) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields])


# Field names, order and types of the published trip files. Timestamps are text in
# the files and are parsed after the read.
GEO_FILE_SCHEMA = _layout(
    [
        ("VendorID", _INT),
        ("tpep_pickup_datetime", _TEXT),
        ("tpep_dropoff_datetime", _TEXT),
        ("passenger_count", _INT),
        ("trip_distance", _DOUBLE),
        ("pickup_longitude", _DOUBLE),
        ("pickup_latitude", _DOUBLE),
        ("RateCodeID", _INT),
        ("store_and_fwd_flag", _TEXT),
        ("dropoff_longitude", _DOUBLE),
        ("dropoff_latitude", _DOUBLE),
        ("payment_type", _INT),
        ("fare_amount", _DOUBLE),
        ("extra", _DOUBLE),
        ("mta_tax", _DOUBLE),
        ("tip_amount", _DOUBLE),
        ("tolls_amount", _DOUBLE),
        ("improvement_surcharge", _DOUBLE),
        ("total_amount", _DOUBLE),
    ]
)
ZONE_FILE_SCHEMA = _layout(
    [
        ("VendorID", _INT),
        ("tpep_pickup_datetime", _TEXT),
        ("tpep_dropoff_datetime", _TEXT),
        ("passenger_count", _INT),
        ("trip_distance", _DOUBLE),
        ("RatecodeID", _INT),
        ("store_and_fwd_flag", _TEXT),
        ("PULocationID", _INT),
        ("DOLocationID", _INT),
        ("payment_type", _INT),
        ("fare_amount", _DOUBLE),
        ("extra", _DOUBLE),
        ("mta_tax", _DOUBLE),
        ("tip_amount", _DOUBLE),
        ("tolls_amount", _DOUBLE),
        ("improvement_surcharge", _DOUBLE),
        ("total_amount", _DOUBLE),
        ("congestion_surcharge", _DOUBLE),
        ("Airport_fee", _DOUBLE),
    ]
)
ZONE_LOOKUP_SCHEMA = _layout(
    [("LocationID", _INT), ("Borough", _TEXT), ("Zone", _TEXT), ("service_zone", _TEXT)]
)

GEO_NAMES = {
    "VendorID": "vendor_id",
    "tpep_pickup_datetime": "pickup_ts",
    "tpep_dropoff_datetime": "dropoff_ts",
    "pickup_latitude": "pickup_latitude",
    "pickup_longitude": "pickup_longitude",
    "dropoff_latitude": "dropoff_latitude",
    "dropoff_longitude": "dropoff_longitude",
    "trip_distance": "trip_distance",
    "fare_amount": "fare_amount",
    "tip_amount": "tip_amount",
}
ZONE_NAMES = {
    "VendorID": "vendor_id",
    "PULocationID": "pu_location_id",
    "DOLocationID": "do_location_id",
    "payment_type": "payment_type",
    "fare_amount": "fare_amount",
    "tip_amount": "tip_amount",
    "total_amount": "total_amount",
    "congestion_surcharge": "congestion_surcharge",
}
AIRPORT_FEE_NAMES = ("airport_fee", "Airport_fee")


def first_column(df: DataFrame, names: tuple[str, ...] | list[str], alias: str) -> Column:
    """The first of several spellings of a column that the frame has (exact spelling)."""
    for name in names:
        if name in df.columns:
            return F.col(name).alias(alias)
    raise ValueError(f"none of {list(names)} among columns {df.columns}")


def to_geo_trips(df: DataFrame) -> DataFrame:
    """Coordinates-layout rows under the common names; unused columns never leave the scan."""
    return df.select([F.col(old).alias(new) for old, new in GEO_NAMES.items()])


def to_zone_trips(df: DataFrame) -> DataFrame:
    """Zone-layout rows under the common names.

    The parsed ``pickup_ts`` is preferred to the raw text column, and the layout columns
    ``pickup_day``/``pickup_hour`` are kept when the table has them, so filters can prune on them.
    """
    kept = [F.col(old).alias(new) for old, new in ZONE_NAMES.items()]
    kept.append(first_column(df, AIRPORT_FEE_NAMES, "airport_fee"))
    kept.append(first_column(df, ("pickup_ts", "tpep_pickup_datetime"), "pickup_ts"))
    kept += [F.col(name) for name in ("pickup_day", "pickup_hour") if name in df.columns]
    return df.select(kept)


def to_zones(df: DataFrame) -> DataFrame:
    """The zone lookup under the common names."""
    return df.select(
        F.col("LocationID").try_cast("int").alias("location_id"),
        F.col("Borough").alias("borough"),
        F.col("Zone").alias("zone"),
        F.col("service_zone"),
    )
