"""Sinks: CSV to Parquet conversion, layouts partitioned by time, CSV export.

Partitioned writes go through a rebalance on the partition columns: every partition gets few
files of the advisory size, small partitions share tasks, and one that holds a third of all rows
is split over many tasks. Without adaptive execution a salted repartition stands in for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tripflow.functions.times import ISO_MICROS_PATTERN, ISO_MILLIS_PATTERN, normalise_iso, parse_timestamp
from tripflow.operators.filters import on_dates
from tripflow.schemas import ZONE_FILE_SCHEMA
from tripflow.sources.readers import read_csv_typed
from tripflow.sources.staging import settle

DAY_HOUR = ("pickup_day", "pickup_hour")
#: Tasks that share a folder where adaptive execution, which would decide by size, is off.
SALTS = 4
#: Rows of one file of a compressed export.
ROWS_A_FILE = 250_000


def csv_to_parquet(
    spark: SparkSession,
    csv_path: str,
    out: str,
    schema: StructType,
    timestamps: tuple[str, ...] = ("tpep_pickup_datetime", "tpep_dropoff_datetime"),
    zone: str = "UTC",
) -> None:
    """Typed CSV to Parquet with the text timestamps parsed, replacing what is at ``out``.

    Fractions are kept; a time with an offset is shown in ``zone`` (see ``normalise_iso``).
    """
    typed = read_csv_typed(spark, csv_path, schema)
    parsed = typed.withColumns({name: normalise_iso(F.col(name), zone) for name in timestamps})
    parsed.write.mode("overwrite").parquet(out)


def with_day_hour(df: DataFrame, ts: str = "pickup_ts", zone: str | None = None) -> DataFrame:
    """Day and hour columns, of UTC times in a named zone if one is given."""
    time = F.col(ts) if zone is None else F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ts))
    return df.withColumns({"pickup_day": F.dayofmonth(time), "pickup_hour": F.hour(time)})


def with_date(df: DataFrame, ts: str = "pickup_ts") -> DataFrame:
    return df.withColumn("pickup_date", F.to_date(ts))


def _write_partitioned(
    df: DataFrame, out: str, columns: tuple[str, ...], tasks: int | None = None
) -> None:
    if tasks:
        spread = df.repartition(tasks)
    elif df.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true":
        spread = df.hint("rebalance", *columns)
    else:
        # Without adaptive execution the hint does nothing. A salt keeps a large folder in a few
        # tasks instead of one, and a small one in a few instead of all.
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))
        spread = df.repartition(*columns, salt)
    spread.write.mode("overwrite").partitionBy(*columns).parquet(out)


def write_by_day_hour(
    df: DataFrame, out: str, ts: str = "pickup_ts", zone: str | None = None
) -> None:
    """Layout ``pickup_day=/pickup_hour=``: a 3-day, 4-hour question opens 12 of 744 folders."""
    _write_partitioned(with_day_hour(df, ts, zone), out, DAY_HOUR)


def zone_csv_to_day_hour(
    spark: SparkSession,
    csv_path: str,
    out: str,
    pattern: str = ISO_MILLIS_PATTERN,
    zone: str | None = None,
) -> None:
    """Zone-layout CSV to the day-and-hour layout, with the pickup time parsed by its pattern."""
    typed = read_csv_typed(spark, csv_path, ZONE_FILE_SCHEMA)
    parsed = typed.withColumn("pickup_ts", parse_timestamp(F.col("tpep_pickup_datetime"), pattern))
    write_by_day_hour(parsed, out, zone=zone)


def write_by_date(
    df: DataFrame,
    out: str,
    dates: list[str] | None = None,
    ts: str = "pickup_ts",
    tasks: int | None = None,
) -> None:
    """Layout ``pickup_date=``, of all dates or of a list of them.

    With ``tasks`` the rows are dealt out evenly to that many writers instead, each of which may
    leave a file in every date.
    """
    dated = with_date(df, ts)
    if dates is not None:
        dated = dated.where(on_dates(F.col("pickup_date"), dates))
    _write_partitioned(dated, out, ("pickup_date",), tasks)


def load_by_date(df: DataFrame, out: str, load: str, ts: str = "pickup_ts") -> None:
    """Write the dates that are in ``df`` to the layout ``pickup_date=``, each replacing what it had.

    For daily loads, reruns and late data: folders of other dates are not touched. When the files are in
    place, a list of them with their rows is appended to ``<out>_loads`` under the name ``load``; a load
    that fails in between leaves the list as it was, and ``loaded`` doesn't read its files.
    """
    spark = df.sparkSession
    written = settle(with_date(df, ts), "load")
    dates = [r[0] for r in written.select("pickup_date").distinct().collect()]
    if spark.conf.get("spark.sql.adaptive.enabled") == "true":
        spread = written.hint("rebalance", "pickup_date")
    else:
        spread = written.repartition("pickup_date", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pickup_date").parquet(out)
    files = (
        spark.read.schema(written.schema).parquet(out).where(F.col("pickup_date").isin(dates))
        .groupBy("pickup_date", F.input_file_name().alias("file")).agg(F.count("*").alias("rows"))
    )
    listed = files.select(F.lit(load).alias("load"), F.current_timestamp().alias("at"), "*")
    listed.coalesce(1).write.mode("append").parquet(f"{out.rstrip('/')}_loads")


def finished_files(spark: SparkSession, out: str) -> DataFrame:
    """(load, at, pickup_date, file, rows) of the last finished load of every date."""
    last = Window.partitionBy("pickup_date").orderBy(F.desc("at"), F.desc("load"))
    listed = spark.read.parquet(f"{out.rstrip('/')}_loads")
    return listed.withColumn("_place", F.dense_rank().over(last)).where(F.col("_place") == 1).drop("_place")


def loaded(spark: SparkSession, out: str) -> DataFrame:
    """The rows of all finished loads: of the files that the list names, no others."""
    files = [r.file for r in finished_files(spark, out).select("file").collect()]
    return spark.read.option("basePath", out).parquet(*files)


def export_csv(
    df: DataFrame, out: str, pattern: str = ISO_MICROS_PATTERN, single_file: bool = False, compression: str = "none"
) -> None:
    """CSV with header and one stated timestamp pattern, by default to the microsecond.

    ``single_file`` runs the whole export through one task; leave it off for anything large. A file
    of a ``compression`` such as gzip is read by one task, so a task then starts a new one every
    ``ROWS_A_FILE`` rows.
    """
    writer = (df.coalesce(1) if single_file else df).write
    if compression != "none":
        # The fast level: files a tenth larger or so for a fraction of the time.
        writer = writer.option("zlib.compress.level", "BEST_SPEED")
        if not single_file:
            writer = writer.option("maxRecordsPerFile", ROWS_A_FILE)
    (
        writer.mode("overwrite")
        .option("header", "true")
        .option("compression", compression)
        .option("timestampFormat", pattern)
        .option("timestampNTZFormat", pattern)
        .csv(out)
    )
