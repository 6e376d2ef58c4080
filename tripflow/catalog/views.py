"""Trip tables derived from the driver's tables, as SQL that Spark and DuckDB both read.

``geo_file`` and ``zone_file`` have the exact columns of the two published file layouts;
``trips_geo``, ``trips_zone`` and ``zones`` carry the common names. Everything is a row-wise
derivation of ``lineitem`` or ``events``, so the work grows with them. The data contains zero and
out-of-range coordinates, non-positive distances, fares and durations, unmatched zones and nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DAY_SECOND = "((l_orderkey * 7919 + l_partkey * 31 + l_linenumber * 1009) % 86400)"

GEO_BASE = f"""
SELECT l_orderkey * 10 + l_linenumber AS trip_id,
       CAST(l_suppkey % 4 AS INT) AS VendorID,
       l_shipdate + INTERVAL '1' SECOND * {_DAY_SECOND}
         + INTERVAL '0.015625' SECOND * (l_partkey % 64) AS tpep_pickup_datetime,
       l_shipdate + INTERVAL '1' SECOND * ({_DAY_SECOND} + l_orderkey % 3600 - 60)
         + INTERVAL '0.015625' SECOND * (l_suppkey % 64) AS tpep_dropoff_datetime,
       CAST(l_linenumber AS INT) AS passenger_count,
       l_quantity - 1 AS trip_distance,
       CAST(-74 AS DOUBLE) + (l_suppkey % 100) / CAST(200 AS DOUBLE) AS pickup_longitude,
       CASE WHEN l_partkey % 50 = 0 THEN CAST(0 AS DOUBLE)
            ELSE CAST(40.5 AS DOUBLE) + (l_partkey % 1000) / CAST(2000 AS DOUBLE) END
         AS pickup_latitude,
       CAST(1 + l_partkey % 6 AS INT) AS RateCodeID,
       CASE WHEN l_returnflag = 'R' THEN 'Y' ELSE 'N' END AS store_and_fwd_flag,
       CASE WHEN l_orderkey % 61 = 0 THEN CAST(200 AS DOUBLE)
            ELSE CAST(-74 AS DOUBLE) + (l_orderkey % 700) / CAST(1400 AS DOUBLE) END
         AS dropoff_longitude,
       CAST(40.5 AS DOUBLE) + (l_orderkey % 1000) / CAST(2000 AS DOUBLE) AS dropoff_latitude,
       CAST(1 + l_linenumber % 4 AS INT) AS payment_type,
       l_extendedprice - 1000 AS fare_amount,
       (l_partkey % 3) / CAST(2 AS DOUBLE) AS extra,
       CAST(0.5 AS DOUBLE) AS mta_tax,
       l_extendedprice * l_discount AS tip_amount,
       CASE WHEN l_orderkey % 20 = 0 THEN CAST(5.54 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
         AS tolls_amount,
       CAST(0.3 AS DOUBLE) AS improvement_surcharge,
       l_extendedprice AS total_amount
FROM {{lineitem}}
"""

ZONE_BASE = """
SELECT event_id AS trip_id,
       CAST(event_id % 3 AS INT) AS VendorID,
       ts AS tpep_pickup_datetime,
       ts + INTERVAL '1' SECOND * (event_id * 37 % 5400 - 60) AS tpep_dropoff_datetime,
       CAST(1 + event_id % 6 AS INT) AS passenger_count,
       value / CAST(4 AS DOUBLE) AS trip_distance,
       CAST(1 + user_id % 6 AS INT) AS RatecodeID,
       CASE WHEN event_id % 40 = 0 THEN 'Y' ELSE 'N' END AS store_and_fwd_flag,
       CAST(user_id % 27 AS INT) AS PULocationID,
       CAST(event_id % 26 AS INT) AS DOLocationID,
       CAST(CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 1 WHEN 'view' THEN 2
            WHEN 'signup' THEN 3 ELSE 4 END AS INT) AS payment_type,
       value - 5 AS fare_amount,
       (event_id % 3) / CAST(2 AS DOUBLE) AS extra,
       CAST(0.5 AS DOUBLE) AS mta_tax,
       value * (event_id % 5) / CAST(20 AS DOUBLE) AS tip_amount,
       CASE WHEN event_id % 20 = 0 THEN CAST(6.94 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
         AS tolls_amount,
       CAST(1 AS DOUBLE) AS improvement_surcharge,
       value AS total_amount,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(2.5 AS DOUBLE) END AS congestion_surcharge,
       CASE WHEN event_id % 11 = 0 THEN CAST(1.75 AS DOUBLE) END AS Airport_fee
FROM {events}
"""

GEO_FILE = """
SELECT VendorID, tpep_pickup_datetime, tpep_dropoff_datetime, passenger_count, trip_distance,
       pickup_longitude, pickup_latitude, RateCodeID, store_and_fwd_flag, dropoff_longitude,
       dropoff_latitude, payment_type, fare_amount, extra, mta_tax, tip_amount, tolls_amount,
       improvement_surcharge, total_amount
FROM {geo_base}
"""

ZONE_FILE = """
SELECT VendorID, tpep_pickup_datetime, tpep_dropoff_datetime, passenger_count, trip_distance,
       RatecodeID, store_and_fwd_flag, PULocationID, DOLocationID, payment_type, fare_amount,
       extra, mta_tax, tip_amount, tolls_amount, improvement_surcharge, total_amount,
       congestion_surcharge, Airport_fee
FROM {zone_base}
"""

TRIPS_GEO = """
SELECT trip_id, VendorID AS vendor_id, tpep_pickup_datetime AS pickup_ts,
       tpep_dropoff_datetime AS dropoff_ts, pickup_latitude, pickup_longitude,
       dropoff_latitude, dropoff_longitude, trip_distance, fare_amount, tip_amount
FROM {geo_base}
"""

TRIPS_ZONE = """
SELECT trip_id, VendorID AS vendor_id, tpep_pickup_datetime AS pickup_ts,
       PULocationID AS pu_location_id, DOLocationID AS do_location_id, payment_type, fare_amount,
       tip_amount, total_amount, congestion_surcharge, Airport_fee AS airport_fee
FROM {zone_base}
"""

ZONES = """
SELECT n_nationkey AS location_id, r_name AS borough, n_name AS zone,
       CASE n_regionkey WHEN 0 THEN 'Airports' WHEN 1 THEN 'Yellow Zone' ELSE 'Boro Zone' END
         AS service_zone
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
"""

# name -> (text, views or tables it reads)
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "geo_base": (GEO_BASE, ("lineitem",)),
    "zone_base": (ZONE_BASE, ("events",)),
    "geo_file": (GEO_FILE, ("geo_base",)),
    "zone_file": (ZONE_FILE, ("zone_base",)),
    "trips_geo": (TRIPS_GEO, ("geo_base",)),
    "trips_zone": (TRIPS_ZONE, ("zone_base",)),
    "zones": (ZONES, ("nation", "region")),
}


class Inputs:
    """The tables and views of one scale directory."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.sf_dir}/{table}.parquet"

    def __getitem__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.spark.read.parquet(self.path(name))
        text, sources = VIEWS[name]
        return self.spark.sql(text, **{source: self[source] for source in sources})


def with_views(sql: str, names: tuple[str, ...]) -> str:
    """The SQL with the views it uses put in front, for an engine that has the tables only."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for source in VIEWS[name][1]:
                visit(source)
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return sql
    parts = [
        f"{name} AS ({VIEWS[name][0].format(**{s: s for s in VIEWS[name][1]})})"
        for name in ordered
    ]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
