from __future__ import annotations

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from tripflow.catalog.inputs import geo_csv, layout_by_day_hour
from tripflow.operators.filters import in_window
from tripflow.params import TripWindow
from tripflow.schemas import (
    GEO_FILE_SCHEMA,
    ZONE_FILE_SCHEMA,
    first_column,
    to_geo_trips,
    to_zone_trips,
    to_zones,
)
from tripflow.sources import readers, staging
from tripflow.sources.writers import (
    SALTS,
    csv_to_parquet,
    export_csv,
    write_by_date,
    write_by_day_hour,
)

SMALL = StructType(
    [
        StructField("id", IntegerType()),
        StructField("x", DoubleType()),
        StructField("note", StringType()),
    ]
)


@pytest.fixture
def folder(tmp_path):
    return lambda name: str(tmp_path / name)


def test_text_lines(spark, rows):
    lines = ["id,x,note", "1,2.5,a", "2,2.5", "x,2.5,a", '3,1.0,"a,b"', "4,1.0,a,b", "id,x,note",
             "5,,a", ""]
    df = spark.createDataFrame([(line,) for line in lines], "value string")
    assert rows(readers.parse_text_lines(df, SMALL)) == [
        (1, 2.5, "a"), (3, 1.0, "a,b"), (4, 1.0, "a"),
    ]
    assert rows(readers.parse_text_lines(df, SMALL, required=["id"])) == [
        (1, 2.5, "a"), (3, 1.0, "a,b"), (4, 1.0, "a"), (5, None, "a"),
    ]


def test_text_lines_with_unreadable_fields_nobody_asked_for(spark, rows):
    df = spark.createDataFrame([("1.0,2.5,a",), ("1.5,2.5,b",), ("x,3.5,c",), ("7,y,d",)], "value string")
    assert rows(readers.parse_text_lines(df, SMALL, required=["x"])) == [
        (1, 2.5, "a"), (None, 2.5, "b"), (None, 3.5, "c"),
    ]


def test_a_header_given_by_its_text(spark, rows):
    df = spark.createDataFrame([("ID|X|NOTE",), ("1,2.5,a",)], "value string")
    assert rows(readers.parse_text_lines(df, SMALL, header="ID|X|NOTE")) == [(1, 2.5, "a")]


def test_a_file_of_another_layout_is_refused(spark, inputs):
    path = geo_csv(inputs)
    assert readers.read_csv_typed(spark, path, GEO_FILE_SCHEMA).count() > 0
    with pytest.raises(Exception, match="header"):
        readers.read_csv_typed(spark, path, ZONE_FILE_SCHEMA).collect()


def test_header_in_another_order_is_refused(spark, folder):
    spark.createDataFrame([(1.5, 1, "a")], "x double, id int, note string").write.option(
        "header", "true"
    ).csv(folder("c"))
    with pytest.raises(Exception, match="header"):
        readers.read_csv_typed(spark, folder("c"), SMALL).collect()


def test_late_cast(spark, rows):
    df = spark.createDataFrame([("1", "x"), ("z", "2.5")], "a string, b string")
    assert rows(readers.late_cast(df, {"a": "int", "b": "double"})) == [(1, None), (None, 2.5)]


def test_column_fallback(spark):
    df = spark.createDataFrame([(1, 2)], "Airport_fee int, other int")
    assert df.select(first_column(df, ("airport_fee", "Airport_fee"), "fee")).columns == ["fee"]
    with pytest.raises(ValueError):
        first_column(df, ("a", "b"), "fee")


def test_file_layouts_map_to_the_common_names(inputs, rows):
    geo = to_geo_trips(inputs["geo_file"])
    assert rows(geo) == rows(inputs["trips_geo"].select(geo.columns))
    zone = to_zone_trips(inputs["zone_file"])
    assert rows(zone) == rows(inputs["trips_zone"].select(zone.columns))
    lookup = inputs["zones"].select(
        F.col("location_id").cast("string").alias("LocationID"),
        F.col("borough").alias("Borough"),
        F.col("zone").alias("Zone"),
        "service_zone",
    )
    assert rows(to_zones(lookup)) == rows(inputs["zones"])


def test_only_chosen_folders_are_scanned(inputs, plan):
    df = layout_by_day_hour(inputs)
    kept = df.where(in_window(df, TripWindow())).agg(F.count("*"))
    text = plan(kept)
    assert "PartitionFilters: [pickup_day" in text and "pickup_hour" in text
    assert "dayofmonth" not in text


def scanned_files(df) -> int:
    """Files the scan really opened, from its metric after the run (plans without a shuffle)."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves().iterator()
    total = 0
    while leaves.hasNext():
        total += leaves.next().metrics().apply("numFiles").value()
    return total


def test_only_files_of_the_window_are_opened(inputs):
    df = layout_by_day_hour(inputs).select("pickup_day", "pickup_hour", "total_amount")
    window = TripWindow()
    opened, everything = scanned_files(df.where(in_window(df, window))), scanned_files(df)
    assert 0 < opened <= len(window.days) * len(window.hours)
    assert everything > 20 * opened


def files_in(path: str, partition: str) -> int:
    return len(glob.glob(f"{path}/{partition}/*.parquet"))


def test_date_layout(spark, folder, zone_trips, rows):
    write_by_date(zone_trips, folder("d"))
    back = spark.read.parquet(folder("d"))
    assert rows(back.select(zone_trips.columns)) == rows(zone_trips)
    assert files_in(folder("d"), "pickup_date=2024-01-09") == 1
    write_by_date(zone_trips, folder("e"), ["2024-01-09", "2024-01-10"])
    assert spark.read.parquet(folder("e")).select("pickup_date").distinct().count() == 2


def test_date_layout_with_a_fixed_number_of_writers(spark, folder, zone_trips):
    write_by_date(zone_trips, folder("f"), tasks=4)
    assert 1 < files_in(folder("f"), "pickup_date=2024-01-09") <= 4
    assert spark.read.parquet(folder("f")).count() == zone_trips.count()


def test_a_hot_partition_is_written_by_several_tasks(spark, folder):
    hot = spark.range(0, 200_000, 1, 8).select(
        F.when(F.col("id") % 3 > 0, F.lit("2024-01-11 12:00:00"))
        .otherwise(F.lit("2024-01-12 12:00:00"))
        .cast("timestamp_ntz")
        .alias("pickup_ts"),
        F.rand(1).alias("x"),
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        write_by_day_hour(hot, folder("h"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert files_in(folder("h"), "pickup_day=11/pickup_hour=12") > 1
    assert spark.read.parquet(folder("h")).count() == 200_000


def test_a_layout_without_adaptive_execution_has_few_files_a_folder(spark, folder):
    days = spark.range(0, 8000, 1, 8).select(
        F.expr("timestamp_ntz'2024-01-01 12:00:00' + make_dt_interval(id % 5)").alias("pickup_ts"), "id"
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        write_by_day_hour(days, folder("n"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert 1 < files_in(folder("n"), "pickup_day=1/pickup_hour=12") <= SALTS
    assert spark.read.parquet(folder("n")).count() == 8000


def test_fractions_and_offsets_survive_conversion_and_export(spark, folder, rows):
    text = "id,tpep_pickup_datetime\n1,2015-01-15T19:05:39.250-05:00\n2,2015-01-15 01:02:03.123456\n"
    with open(folder("t.csv"), "w") as out:
        out.write(text)
    schema = StructType([StructField("id", IntegerType()), StructField("tpep_pickup_datetime", StringType())])
    csv_to_parquet(spark, folder("t.csv"), folder("p"), schema, ("tpep_pickup_datetime",))
    stored = spark.read.parquet(folder("p"))
    expected = [(1, dt.datetime(2015, 1, 16, 0, 5, 39, 250000)), (2, dt.datetime(2015, 1, 15, 1, 2, 3, 123456))]
    assert rows(stored) == expected
    export_csv(stored, folder("e"))
    csv_to_parquet(spark, folder("e"), folder("q"), schema, ("tpep_pickup_datetime",))
    assert rows(spark.read.parquet(folder("q"))) == expected


def test_export_in_parts_or_one_file(spark, folder):
    df = spark.range(0, 1000, 1, 4)
    export_csv(df, folder("many"))
    export_csv(df, folder("one"), single_file=True)
    assert len(glob.glob(folder("many") + "/*.csv")) == 4
    assert len(glob.glob(folder("one") + "/*.csv")) == 1


def test_schema_report(spark, rows):
    df = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    assert rows(readers.schema_report(df)) == [(0, "a", "int", 2), (1, "b", "string", 1)]


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Session:
    def __init__(self, **values):
        self.conf = _Conf(values)


def test_shared_folder_is_the_one_the_session_names():
    named = _Session(**{"spark.checkpoint.dir": "hdfs:///shared", "spark.master": "yarn"})
    assert staging.shared_folder(named) == "hdfs:///shared"
    assert staging.new_path(named, "x").startswith("hdfs:///shared/tripflow/")


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_folder(_Session(**{"spark.master": "yarn", "spark.app.id": "app"}))


def test_executors_of_a_local_cluster_share_no_temporary_folder():
    values = {"spark.master": "local-cluster[2,1,1024]", "spark.app.id": "app"}
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_folder(_Session(**values))


def test_clear_removes_what_was_written(spark, tmp_path):
    class Session:
        conf = _Conf({"spark.checkpoint.dir": str(tmp_path), "spark.app.id": "one"})
        sparkContext = spark.sparkContext

    spark.range(3).write.parquet(staging.new_path(Session, "x"))
    assert [p.name for p in (tmp_path / "tripflow").iterdir()] == ["one"]
    staging.clear(Session)
    assert not list((tmp_path / "tripflow").iterdir())


def test_settle_keeps_rows_and_types(spark, rows):
    df = spark.range(10).select("id", F.lit("x").alias("s"))
    back = staging.settle(df)
    assert rows(back) == rows(df)
    assert [f.dataType for f in back.schema] == [f.dataType for f in df.schema]
