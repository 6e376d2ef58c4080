"""Table functions: order, places, runs, nulls and lateral joins."""

from __future__ import annotations

from tripflow.functions.tables import register_table_functions


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_best_rows_keeps_columns_and_order(spark):
    register_table_functions(spark)
    rows = [("a", 3, 1.0), ("a", 1, 2.0), ("a", 2, None), ("b", 1, 5.0)] + [("c", i, float(-i)) for i in range(100)]
    frame = spark.createDataFrame(rows, "k string, at int, v double").repartition(5)
    found = spark.sql("SELECT * FROM best_rows(TABLE({t}) PARTITION BY k ORDER BY (v DESC, at), 2)", t=frame)
    assert found.columns == ["k", "at", "v", "place"]
    assert _rows(found) == [("a", 1, 2.0, 1), ("a", 3, 1.0, 2), ("b", 1, 5.0, 1), ("c", 0, 0.0, 1), ("c", 1, -1.0, 2)]
    assert spark.sql("SELECT * FROM best_rows(TABLE({t}) PARTITION BY k ORDER BY (at), 2)", t=frame.limit(0)).collect() == []


def test_rising_runs(spark):
    register_table_functions(spark)
    values = [1, 2, 2, 3, None, 4, 9, 1]
    rows = [(1, i, v) for i, v in enumerate(values)] + [(None, 0, 5), (2, 0, None)]
    frame = spark.createDataFrame(rows, "k int, at int, v int")
    found = spark.sql("SELECT * FROM rising_runs(TABLE({t}) PARTITION BY k ORDER BY at)", t=frame).collect()
    assert {(r.k, r.start, r.stop, r.length, r.gain) for r in found} == {
        (1, 0, 1, 2, 1), (1, 2, 3, 2, 1), (1, 5, 6, 2, 5), (1, 7, 7, 1, 0), (None, 0, 0, 1, 0),
    }


def test_window_hours_in_a_lateral_join(spark):
    register_table_functions(spark)
    frame = spark.createDataFrame([("x", 22, 4), ("y", 5, 0), ("z", None, 3)], "name string, start int, n int")
    found = spark.sql("SELECT name, hour, day_shift FROM {t}, LATERAL window_hours(start, n)", t=frame)
    assert _rows(found) == [("x", 0, 1), ("x", 1, 1), ("x", 22, 0), ("x", 23, 0)]
