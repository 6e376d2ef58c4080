"""One CSV file written by many tasks."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tripflow.sources import single_file
from tripflow.sources.readers import read_csv_typed


@pytest.fixture
def rows(spark):
    note = F.when(F.col("id") % 7 == 0, 'a,"b"').when(F.col("id") % 11 == 0, None).otherwise(F.concat(F.lit("ü"), F.col("id")))
    return spark.range(0, 5000, 1, 9).select("id", (F.col("id") / 4).alias("x"), note.alias("no, te"))


@pytest.mark.parametrize("copied", [100, 8 << 20])
def test_one_header_and_all_rows_in_order(spark, rows, tmp_path, monkeypatch, copied):
    monkeypatch.setattr(single_file, "COPIED", copied)
    out = str(tmp_path / "trips.csv")
    single_file.export_one_csv(rows, out, [F.desc("id")])
    assert os.path.isfile(out) and sorted(os.listdir(tmp_path)) == sorted(n for n in os.listdir(tmp_path) if n.endswith((".csv", ".crc")))
    with open(out, encoding="utf-8") as file:
        lines = file.read().splitlines()
    assert lines[0] == 'id,x,"no, te"' and len(lines) == 5001 and [int(line.partition(",")[0]) for line in lines[1:]] == list(range(4999, -1, -1))
    back = read_csv_typed(spark, out, rows.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))


def test_no_stage_of_one_task_holds_the_rows(spark, rows, tmp_path):
    """The sort and the copy run in as many tasks as there are parts."""
    spark.sparkContext.setJobGroup("one-file", "one file")
    single_file.export_one_csv(rows, str(tmp_path / "a.csv"), ["id"])
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("one-file") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # One task only where a header line is written, or counts of tasks are added up.
    assert max(s.numTasks for s in stages if s) >= 8


def test_what_is_there_is_replaced_and_empty_frames_have_a_header(spark, rows, tmp_path):
    out = str(tmp_path / "a.csv")
    single_file.export_one_csv(rows, out, ["id"])
    single_file.export_one_csv(rows.where("id < 0"), out, ["id"])
    with open(out, encoding="utf-8") as file:
        assert file.read() == 'id,x,"no, te"\n'


def test_other_stores_refuse(spark, rows):
    with pytest.raises(Exception, match="(?i)scheme|file system|filesystem|cannot join"):
        single_file.join_parts(spark, ["s3x://bucket/parts"], "s3x://bucket/a.csv")
