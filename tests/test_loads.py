"""Rejected lines, remembered schemas, repeated loads and pruning by a joined calendar."""

from __future__ import annotations

import datetime as dt
import os
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType, TimestampNTZType

from tripflow.catalog import layouts
from tripflow.catalog.inputs import by_date, calendar, geo_csv, zone_csv
from tripflow.functions.times import normalise_iso
from tripflow.operators.joins import on_calendar
from tripflow.sources import readers, staging, writers
from tripflow.sources.writers import export_csv, finished_files, load_by_date, loaded

SCHEMA = StructType().add("id", IntegerType()).add("at", TimestampNTZType()).add("fare", DoubleType()).add("note", StringType())


def test_kept_and_rejected_are_all_lines(spark):
    lines = [
        "id,at,fare,note", "1,2024-01-01 10:00:00,2.5,x", "2,2024-01-01 10:00:00,,x", "3,never,abc,x", "4,2024-01-01 10:00:00",
        "", "5,2024-01-01 10:00:00,1,more,fields", '6,2024-01-01 10:00:00,1,"a,b"', "id,at,fare,note", "1.0,2024-01-01 10:00:00,7,",
    ]
    frame = spark.createDataFrame([(line,) for line in lines], "value string").repartition(3)
    kept, rejected = readers.split_text_lines(frame, SCHEMA, ["id", "at", "fare"])
    assert sorted((r.id, r.fare, r.note) for r in kept.collect()) == [(1, 2.5, "x"), (1, 7.0, None), (5, 1.0, "more"), (6, 1.0, "a,b")]
    assert sorted((r.reason, r.value) for r in rejected.collect()) == [
        ("header", lines[0]), ("header", lines[0]), ("too few fields", ""), ("too few fields", lines[4]),
        ("unreadable: at fare", lines[3]), ("unreadable: fare", lines[2]),
    ]
    assert kept.count() + rejected.count() == len(lines)
    same = readers.parse_text_lines(frame, SCHEMA, ["id", "at", "fare"])
    assert same.schema == kept.schema and sorted(map(str, same.collect())) == sorted(map(str, kept.collect()))
    none, no = readers.split_text_lines(frame.limit(0), SCHEMA)
    assert none.count() == no.count() == 0 and none.columns == SCHEMA.fieldNames()


def test_inferred_types_are_those_of_spark(spark, inputs, tmp_path):
    ours = readers.infer_types(readers.read_csv_text(spark, geo_csv(inputs)))
    theirs = readers.read_csv_inferred(spark, geo_csv(inputs)).schema
    assert [(f.name, f.dataType.simpleString().replace("timestamp_ntz", "timestamp")) for f in ours] == [
        (f.name, f.dataType.simpleString()) for f in theirs
    ]
    rows = [
        ("1", "1", "1", "2024-01-01", "2024-01-01", "true", "", "1", "a", " 7", "1e3", "2024-01-01"),
        ("-2", "3000000000", "2.5", "2024-12-31", "2024-01-01 10:00:00", "FALSE", "", "x", "1", "8 ", "5", "7"),
        ("007", "5", "-.5", "", "2024-01-01T10:00:00.5", "", "", "", "", "", "", ""),
    ]
    names = [f"c{i}" for i in range(len(rows[0]))]
    path = str(tmp_path / "few.csv")
    spark.createDataFrame(rows, names).coalesce(1).write.option("header", "true").csv(path)
    kinds = [f.dataType.simpleString() for f in readers.infer_types(readers.read_csv_text(spark, path))]
    assert kinds == ["int", "bigint", "double", "date", "timestamp_ntz", "boolean", "string", "string", "string", "int", "double", "string"]


def test_schema_is_kept_beside_the_file(spark, geo, tmp_path):
    path = str(tmp_path / "trips.csv")
    export_csv(geo, path)
    first = readers.read_csv_remembered(spark, path)
    assert os.path.exists(f"{path}.schema")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    second = readers.read_csv_remembered(spark, path)
    # The second read runs one job, over the kept schema, and none over the trips.
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - len(before) <= 1
    assert second.schema == first.schema and second.count() == geo.count()
    assert dict(second.dtypes)["pickup_ts"] == "timestamp_ntz"


def _files(out):
    return {str(p.relative_to(out)): p.stat().st_mtime_ns for p in Path(out).glob("pickup_date=*/*.parquet")}


def test_a_second_load_leaves_other_days_alone(spark, zone_trips, tmp_path):
    out = str(tmp_path / "trips")
    load_by_date(zone_trips.where("trip_id % 5 <> 0"), out, "first")
    before = _files(out)
    late = zone_trips.where(F.to_date("pickup_ts") == "2024-01-10")
    load_by_date(late, out, "late")
    after = _files(out)
    same = {k: v for k, v in before.items() if "2024-01-10" not in k}
    assert same and {k: v for k, v in after.items() if "2024-01-10" not in k} == same
    assert not {k for k in before if "2024-01-10" in k} & set(after)
    day = dt.date(2024, 1, 10)
    named = {r.pickup_date: r for r in finished_files(spark, out).collect()}
    assert named[day].load == "late" and {r.load for d, r in named.items() if d != day} == {"first"}
    want = zone_trips.where((F.col("trip_id") % 5 != 0) | (F.to_date("pickup_ts") == "2024-01-10"))
    assert sorted(r.trip_id for r in loaded(spark, out).collect()) == sorted(r.trip_id for r in want.collect())


def test_files_of_a_load_that_failed_are_not_read(spark, zone_trips, tmp_path):
    out = str(tmp_path / "trips")
    load_by_date(zone_trips, out, "first")
    zone_trips.limit(3).select("*", F.lit(dt.date(2030, 1, 1)).alias("pickup_date")).write.mode("append").partitionBy("pickup_date").parquet(out)
    assert loaded(spark, out).count() == zone_trips.count()
    assert spark.read.parquet(out).count() == zone_trips.count() + 3


@pytest.mark.parametrize("weekday", [1, 7])
def test_calendar_prunes_folders_at_run_time(inputs, plan, weekday):
    trips = inputs.spark.read.parquet(by_date(inputs))
    found = on_calendar(trips, calendar(inputs), F.col("weekday") == weekday)
    assert re.search(r"PartitionFilters: \[.*dynamicpruning", plan(found, "formatted"))
    days = {r.pickup_date for r in found.select("pickup_date").distinct().collect()}
    assert days and all(d.isoweekday() == weekday for d in days)
    assert found.count() == trips.where(F.weekday("pickup_date") + 1 == weekday).count()


def test_compressed_exports_are_many_files(spark, monkeypatch, tmp_path):
    """Files that one task must read are bounded in rows; what is written is a part of the plain text."""
    monkeypatch.setattr(writers, "ROWS_A_FILE", 1000)
    rows = spark.range(0, 5000, 1, 1).select("id", F.sqrt("id").alias("x"), F.lit("a,b").alias("note"))
    export_csv(rows, str(tmp_path / "plain"))
    export_csv(rows, str(tmp_path / "packed"), compression="gzip")
    plain, packed = (list((tmp_path / name).glob("part-*")) for name in ("plain", "packed"))
    assert len(plain) == 1 and len(packed) == 5 and all(p.name.endswith(".csv.gz") for p in packed)
    assert sum(p.stat().st_size for p in packed) < 0.7 * plain[0].stat().st_size
    back = readers.read_csv_typed(spark, str(tmp_path / "packed"), rows.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_inputs_and_round_trip_are_written_compressed(spark, inputs, monkeypatch):
    monkeypatch.setattr(staging, "_written", {k: v for k, v in staging._written.items() if k[0] == "folder"})
    layouts._roundtrip(inputs)
    written = spark.read.format("binaryFile").load([geo_csv(inputs), zone_csv(inputs), staging._written[_key(spark, inputs, "geo_export")]])
    assert {r.path.rpartition(".")[2] for r in written.select("path").collect()} == {"gz"}


def _key(spark, inputs, name):
    return spark.conf.get("spark.app.id"), inputs.sf_dir, name


def test_every_value_is_tested_by_one_expression(spark):
    """Types are inferred from (column, value) rows, so the test is compiled once however many columns there are."""
    wide = spark.createDataFrame([tuple(str(i) for i in range(60))], [f"c{i}" for i in range(60)])
    seen = []
    plain = readers._kind

    def counting(value):
        seen.append(value)
        return plain(value)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(readers, "_kind", counting)
        assert {f.dataType for f in readers.infer_types(wide)} == {IntegerType()}
    assert len(seen) == 1


def test_kinds_of_odd_values(spark):
    values = ["1", "-2147483648", "2147483648", "9" * 30, "1.", ".5", "1e3", "1E3", " 7\t", "+ 7", "1d", "NaN", "", "e", ".", "1e", "2024-02-30",
              "2024-02-29", "2024-02-29T10:00", "TRUE", None]
    frame = spark.createDataFrame([(v,) for v in values], "v string").coalesce(1)
    kinds = [r[0] for r in frame.select(readers._kind(F.col("v"))).collect()]
    assert kinds == [1, 1, 2, 4, 4, 4, 4, 4, 1, 64, 64, 64, 64, 64, 64, 64, 64, 8, 16, 32, None]


@pytest.mark.parametrize(
    ("text", "at"),
    [("2015-01-15 19:05:39", dt.datetime(2015, 1, 15, 19, 5, 39)), ("2015-01-15T19:05:39.123456789", dt.datetime(2015, 1, 15, 19, 5, 39, 123456)),
     ("2015-01-15T19:05:39-05:00", dt.datetime(2015, 1, 16, 0, 5, 39)), ("2015-01-15T19:05:39Z", dt.datetime(2015, 1, 15, 19, 5, 39)),
     ("2015-02-30 19:05:39", None), ("2015-01-15 25:05:39", None), ("2015-01-15", None), (" 2015-01-15 19:05:39", None), (None, None)],
)
def test_times_with_and_without_an_offset(spark, text, at):
    assert spark.createDataFrame([(text,)], "t string").select(normalise_iso(F.col("t"))).first()[0] == at
