"""CSV, text and partitioned inputs, written from the derived views on first use.

The files stand for what the jobs would find on a cluster. Each is written by Spark to the shared
folder once per application and scale, with all rows of its view. Large ones are compressed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripflow.catalog.views import Inputs
from tripflow.functions.times import (
    ISO_MICROS_PATTERN,
    PLAIN_MICROS_PATTERN,
    normalise_iso,
    parse_timestamp,
)
from tripflow.schemas import (
    GEO_FILE_SCHEMA,
    ZONE_LOOKUP_SCHEMA,
    to_geo_trips,
    to_zone_trips,
    to_zones,
)
from tripflow.sources.readers import (
    late_cast,
    read_csv_inferred,
    read_csv_text,
    read_csv_typed,
    read_text_lines,
)
from tripflow.sources.staging import written_once
from tripflow.sources.writers import (
    csv_to_parquet,
    export_csv,
    with_day_hour,
    write_by_date,
    zone_csv_to_day_hour,
)

STAMPS = ("tpep_pickup_datetime", "tpep_dropoff_datetime")


def geo_csv(t: Inputs) -> str:
    """The coordinates layout as CSV, times as plain text."""
    return written_once(
        t.spark, "geo_csv", t.sf_dir, lambda out: export_csv(t["geo_file"], out, PLAIN_MICROS_PATTERN, compression="gzip")
    )


def zone_csv(t: Inputs) -> str:
    """The zone layout as CSV, times as ISO text with microseconds."""
    return written_once(
        t.spark,
        "zone_csv",
        t.sf_dir,
        lambda out: export_csv(t["zone_file"], out, ISO_MICROS_PATTERN, compression="gzip"),
    )


def trip_lines(t: Inputs) -> str:
    """The zone layout as text lines with header lines, some of them broken by rule.

    Every 13th trip loses its last three fields, every 17th gets letters for its distance. Every
    11th has a field too many, every 19th its passengers written with a point and every 23rd letters
    for a toll: these are good lines. They are otherwise as in ``zone_csv``, nulls as empty text.
    """

    def write(out: str) -> None:
        base = t["zone_base"]
        names = t["zone_file"].columns
        shown = {
            name: F.date_format(name, ISO_MICROS_PATTERN) for name in STAMPS
        } | {
            "trip_distance": F.when(F.col("trip_id") % 17 == 0, F.lit("n/a")).otherwise(
                F.col("trip_distance").cast("string")
            ),
            "passenger_count": F.concat(
                F.col("passenger_count").cast("string"),
                F.when(F.col("trip_id") % 19 == 0, F.lit(".0")).otherwise(F.lit("")),
            ),
            "tolls_amount": F.when(F.col("trip_id") % 23 == 0, F.lit("none")).otherwise(
                F.col("tolls_amount").cast("string")
            ),
        }
        text = [
            F.coalesce(shown.get(name, F.col(name).cast("string")), F.lit("")) for name in names
        ]
        line = (
            F.when(F.col("trip_id") % 13 == 0, F.concat_ws(",", *text[:-3]))
            .when(F.col("trip_id") % 11 == 0, F.concat_ws(",", *text, F.lit("more")))
            .otherwise(F.concat_ws(",", *text))
        )
        # One header line for every thousand lines, as in a table joined from many files.
        header = F.when(F.col("trip_id") % 1000 == 0, F.lit(",".join(names)))
        lines = base.select(
            F.explode(F.array_compact(F.array(header, line))).alias("value")
        )
        lines.write.text(out)

    return written_once(t.spark, "trip_lines", t.sf_dir, write)


def by_day_hour(t: Inputs, zone: str | None = None) -> str:
    """The zone layout by day and hour, of a named zone if one is given, made from its CSV."""
    return written_once(
        t.spark,
        f"by_day_hour_{(zone or 'wall_clock').replace('/', '_')}",
        t.sf_dir,
        lambda out: zone_csv_to_day_hour(t.spark, zone_csv(t), out, ISO_MICROS_PATTERN, zone),
    )


def by_date(t: Inputs, dates: list[str] | None = None) -> str:
    name = "by_date" if dates is None else "by_date_" + "_".join(dates)
    return written_once(
        t.spark, name, t.sf_dir, lambda out: write_by_date(t["trips_zone"], out, dates)
    )


def calendar(t: Inputs) -> DataFrame:
    """(pickup_date, weekday) of all days from the first to the last trip; Monday is 1."""

    def write(out: str) -> None:
        ends = t["trips_zone"].agg(F.min("pickup_ts").alias("a"), F.max("pickup_ts").alias("b"))
        days = ends.select(F.explode(F.sequence(F.to_date("a"), F.to_date("b"))).alias("pickup_date"))
        days.withColumn("weekday", F.weekday("pickup_date") + 1).write.parquet(out)

    return t.spark.read.parquet(written_once(t.spark, "calendar", t.sf_dir, write))


def layout_by_day_hour(t: Inputs, zone: str | None = None) -> DataFrame:
    return to_zone_trips(t.spark.read.parquet(by_day_hour(t, zone)))


def zones_from_csv(t: Inputs) -> DataFrame:
    """The zone lookup from a CSV file, by way of its Parquet conversion."""

    def as_csv(out: str) -> None:
        renamed = t["zones"].select(
            F.col("location_id").alias("LocationID"), F.col("borough").alias("Borough"),
            F.col("zone").alias("Zone"), "service_zone",
        )
        export_csv(renamed, out)

    path = written_once(t.spark, "zones_csv", t.sf_dir, as_csv)
    converted = written_once(
        t.spark, "zones_parquet", t.sf_dir,
        lambda out: csv_to_parquet(t.spark, path, out, ZONE_LOOKUP_SCHEMA, timestamps=()),
    )
    return to_zones(t.spark.read.parquet(converted))


def geo_from_lines(t: Inputs) -> DataFrame:
    """Coordinates trips from plain text lines of the CSV, parsed field by field."""
    required = ["tpep_pickup_datetime", "tpep_dropoff_datetime"]
    lines = read_text_lines(t.spark, geo_csv(t), GEO_FILE_SCHEMA, required)
    return to_geo_trips(lines.withColumns({name: normalise_iso(F.col(name)) for name in STAMPS}))


def geo_from_inferred_csv(t: Inputs) -> DataFrame:
    """Coordinates trips from a CSV with inferred types and ISO text times."""
    path = written_once(
        t.spark, "geo_iso_csv", t.sf_dir,
        lambda out: export_csv(t["geo_file"], out, ISO_MICROS_PATTERN, compression="gzip"),
    )
    # The inferred type would follow the session zone; the text is normalised instead.
    df = read_csv_inferred(t.spark, path, inferTimestamp="false", prefersDate="false")
    stamps = {name: normalise_iso(F.date_format(name, ISO_MICROS_PATTERN)) if dict(df.dtypes)[name] != "string"
              else normalise_iso(F.col(name)) for name in STAMPS}
    return to_geo_trips(df.withColumns(stamps))


def geo_from_csv(t: Inputs, path: str) -> DataFrame:
    """Coordinates trips from a typed CSV scan."""
    df = read_csv_typed(t.spark, path, GEO_FILE_SCHEMA)
    return to_geo_trips(df.withColumns({name: normalise_iso(F.col(name)) for name in STAMPS}))


def zone_from_csv_text(t: Inputs) -> DataFrame:
    """Zone trips from an all-text CSV scan: times by pattern, numbers cast late."""
    raw = read_csv_text(t.spark, zone_csv(t))
    typed = late_cast(
        raw,
        {
            "VendorID": "int",
            "tpep_pickup_datetime": "string",
            "PULocationID": "int",
            "DOLocationID": "int",
            "payment_type": "int",
            "fare_amount": "double",
            "tip_amount": "double",
            "total_amount": "double",
            "congestion_surcharge": "double",
            "Airport_fee": "double",
        },
    ).withColumn("pickup_ts", parse_timestamp(F.col("tpep_pickup_datetime"), ISO_MICROS_PATTERN))
    return to_zone_trips(with_day_hour(typed))
