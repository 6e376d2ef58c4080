"""User aggregates, bounded samples and stored sketches."""

from __future__ import annotations

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripflow import TripWindow, catalog
from tripflow.catalog import mergeable as mergeable_queries
from tripflow.catalog.views import Inputs
from tripflow.operators import user_aggregates
from tripflow.operators.mergeable import BottomK, Moments
from tripflow.operators.sampling import seeded_hash
from tripflow.operators.user_aggregates import aggregate_by_key, merge_states, partial_states
from tripflow.plans import profile_sketches
from tripflow.plans.hourly_profile import hourly_profile, hourly_profile_sampled
from tripflow.sources import staging

W = TripWindow()


def _split(rng, values, parts):
    cuts = sorted(rng.randrange(len(values) + 1) for _ in range(parts - 1))
    return [values[a:b] for a, b in zip([0, *cuts], [*cuts, len(values)], strict=True)]


def test_moments_do_not_depend_on_the_split():
    rng = random.Random(1)
    # A large offset, where sums of squares would cancel.
    values = np.array([1e9 + rng.gauss(0, 2) for _ in range(1000)])
    for parts in (1, 2, 9):
        moments = Moments()
        state = moments.create()
        for part in _split(rng, values, parts):
            other = moments.update(moments.create(), part)
            state = moments.merge(state, moments.from_bytes(moments.to_bytes(other)))
        n, mean, variance, low, high = moments.finish(state)
        assert (n, low, high) == (1000, values.min(), values.max())
        assert math.isclose(mean, statistics.fmean(values)) and math.isclose(variance, statistics.variance(values.tolist()), rel_tol=1e-6)
    assert moments.finish(moments.create()) == (0, None, None, None, None)
    assert moments.finish(moments.update(moments.create(), np.array([3.0])))[2] is None


@pytest.mark.parametrize("k", [1, 10, 5000])
def test_bottom_k_is_the_k_least_hashes(k):
    rng = random.Random(k)
    rows = [(rng.randrange(300), rng.random()) for _ in range(1000)]  # many equal hashes
    want = sorted(rows)[:k]
    for parts in (1, 7):
        bottom = BottomK(k, 0.9)
        state = bottom.create()
        for part in _split(rng, rows, parts):
            h, v = (np.array(c) for c in zip(*part, strict=True)) if part else (np.zeros(0, np.int64), np.zeros(0))
            state = bottom.merge(state, bottom.from_bytes(bottom.to_bytes(bottom.update(bottom.create(), h, v))))
        assert sorted(zip(state[1].tolist(), state[2].tolist(), strict=True)) == want
        seen, sampled, estimate, error = bottom.finish(state)
        assert (seen, sampled) == (1000, len(want))
        assert estimate == sorted(v for _, v in want)[max(1, math.ceil(0.9 * len(want))) - 1]
        assert (error == 0) == (k >= 1000)
    assert bottom.finish(bottom.update(bottom.create(), np.array([1]), np.array([math.nan]))) == (0, 0, None, None)


def test_bottom_k_error_holds_for_many_seeds(spark):
    """Of 200 samples of 500 out of 20,000, none misses its bound at a risk of 1e-9, some come near one of 0.5."""
    values = np.random.default_rng(3).permutation(20_000).astype(np.float64)
    worst = 0
    for seed in range(200):
        hashes = np.random.default_rng(seed).integers(0, 2**60, 20_000)
        bottom = BottomK(500, 0.9)
        _, _, estimate, error = bottom.finish(bottom.update(bottom.create(), hashes, values))
        miss = abs(estimate + 1 - 18_000)
        assert miss <= error
        worst = max(worst, miss)
    loose = BottomK(500, 0.9, risk=0.5)
    assert worst > 0.3 * loose.finish(loose.update(loose.create(), hashes, values))[3]


def test_odd_keys_and_values(spark):
    rows = [("a", 1, 1.0), ("a", 1, 3.0), ("a", None, 5.0), (None, 1, 7.0), (None, 1, None), ("b", 2, None)]
    frame = spark.createDataFrame(rows, "k string, j int, v double").repartition(4)
    found = {(r.k, r.j): (r.rows, r["mean"]) for r in aggregate_by_key(frame, ["k", "j"], ["v"], Moments()).collect()}
    assert found == {("a", 1): (2, 2.0), ("a", None): (1, 5.0), (None, 1): (1, 7.0), ("b", 2): (0, None)}
    assert [tuple(r)[:2] for r in aggregate_by_key(frame, [], ["v"], Moments()).collect()] == [(4, 4.0)]
    assert aggregate_by_key(frame.limit(0), ["k"], ["v"], Moments()).collect() == []
    assert aggregate_by_key(frame.limit(0), [], ["v"], Moments()).collect() == []
    types = frame.select(F.current_date().alias("d"), F.lit(1.5).cast("decimal(9,2)").alias("e"), F.array("k").alias("v0"), "v")
    assert aggregate_by_key(types, ["d", "e"], ["v"], Moments()).select("rows").collect() == [(4,)]


def test_a_hot_key_sends_one_state_a_task(spark, monkeypatch):
    """A key of a third of the rows is merged from every task, in two rounds, and never held whole."""
    monkeypatch.setattr(user_aggregates, "FAN_IN", 4)
    rows = spark.range(0, 90_000, 1, 32).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.sqrt("id").alias("v")
    )
    states = partial_states(rows, ["k"], ["v"], Moments())
    counted = {r.k: (r.n, r.tasks) for r in states.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("_task").alias("tasks")).collect()}
    assert counted[0] == (32, 8) and states.count() <= 32 * 50
    found = {r.k: r for r in merge_states(states, ["k"], Moments()).collect()}
    want = rows.groupBy("k").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("s")).collect()
    for r in want:
        assert found[r.k].rows == r.n and math.isclose(found[r.k]["mean"], r.m) and math.isclose(found[r.k].variance, r.s)


def test_states_are_flushed(spark, monkeypatch):
    monkeypatch.setattr(user_aggregates, "HELD_KEYS", 3)
    rows = spark.range(0, 5000, 1, 2).select((F.col("id") % 40).alias("k"), F.col("id").cast("double").alias("v"))
    with_batches = partial_states(rows, ["k"], ["v"], Moments())
    assert with_batches.count() >= 80
    assert {r.k: r.rows for r in merge_states(with_batches, ["k"], Moments()).collect()} == dict.fromkeys(range(40), 125)


def test_merged_states_are_a_table_to_merge_again(spark):
    rows = spark.range(1000).select((F.col("id") % 4).alias("day"), (F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    daily = merge_states(partial_states(rows, ["day", "k"], ["v"], Moments()), ["day", "k"], Moments(), finish=False)
    whole = {r.k: tuple(r) for r in merge_states(daily.where("day < 2").drop("day"), ["k"], Moments()).collect()}
    for r in rows.where("day < 2").groupBy("k").agg(F.count("v"), F.avg("v")).collect():
        assert whole[r.k][1] == r[1] and math.isclose(whole[r.k][2], r[2])


def test_sample_is_the_same_in_every_split(spark, geo):
    one, two = (hourly_profile_sampled(geo.repartition(n), W, k=20).collect() for n in (2, 9))
    assert one == two and all(r.sampled == min(20, r.trips) for r in one)
    exact = {r.pickup_hour: r.p90_km for r in hourly_profile(geo, W).collect()}
    whole = {r.pickup_hour: (r.p90_sampled, r.rank_error) for r in hourly_profile_sampled(geo, W).collect()}
    assert whole == {h: (p, 0.0) for h, p in exact.items()}
    hashes = geo.select(seeded_hash(F.col("trip_id")).alias("a"), seeded_hash(F.col("trip_id"), 7).alias("b")).collect()
    assert len({r.a for r in hashes}) == len({r.b for r in hashes}) == geo.select("trip_id").distinct().count()


def test_stored_sketches_answer_any_window(spark, geo, plan, tmp_path):
    profile_sketches.sketch_trips(geo).write.parquet(f"{tmp_path}/sketches")
    sketches = spark.read.parquet(f"{tmp_path}/sketches")
    assert sketches.groupBy("pickup_date", "pickup_hour").count().where("count > 1").isEmpty()
    for window in (W, TripWindow(hour_start=22, hour_count=4, day_start=1, day_count=31), TripWindow(day_start=31, day_count=1)):
        found = profile_sketches.profile_from_sketches(sketches, window)
        assert "sketches" in plan(found, "formatted") and "lineitem" not in plan(found, "formatted")
        days = geo.where(F.dayofmonth("pickup_ts").isin(window.days))
        want = {r.pickup_hour: r for r in hourly_profile(days, window).collect()}
        got = {r.pickup_hour: r for r in found.collect()}
        assert set(got) == set(want)
        for hour, r in got.items():
            # So few trips an hour that a sketch holds all of them.
            assert r.trips == want[hour].trips and math.isclose(r.avg_duration_min, want[hour].avg_duration_min)
            assert abs(r.p90_km - want[hour].p90_km) < 1e-6


def test_late_trips_are_appended_to_the_sketches(spark, geo, tmp_path):
    late = F.col("trip_id") % 5 == 0
    profile_sketches.sketch_trips(geo.where(~late)).write.parquet(f"{tmp_path}/sketches")
    profile_sketches.sketch_trips(geo.where(late)).write.mode("append").parquet(f"{tmp_path}/sketches")
    found = profile_sketches.profile_from_sketches(spark.read.parquet(f"{tmp_path}/sketches"), W).collect()
    whole = profile_sketches.profile_from_sketches(profile_sketches.sketch_trips(geo), W).collect()
    assert [(r.pickup_hour, r.trips, round(r.avg_duration_min, 9), r.p90_km) for r in found] == [
        (r.pickup_hour, r.trips, round(r.avg_duration_min, 9), r.p90_km) for r in whole
    ]


def test_sampled_profile_stands_on_every_row(spark, tmp_path):
    """Of hours with more trips than any sample of the query ever had: the rows are those of the exact profile."""
    start = F.expr("timestamp_ntz'2024-01-11 11:00:00'")
    lineitem = spark.range(0, 40_000, 1, 4).select(
        "id", (F.col("id") % 997 + 1).alias("l_orderkey"), (F.col("id") % 7919 + 1).alias("l_partkey"),
        (F.col("id") % 89 + 1).alias("l_suppkey"), (F.col("id") % 7 + 1).cast("int").alias("l_linenumber"),
        F.lit(10.0).alias("l_quantity"), F.lit(2000.0).alias("l_extendedprice"), F.lit(0.1).alias("l_discount"),
        F.lit("R").alias("l_returnflag"), start.alias("l_shipdate"),
    )
    lineitem.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalog.queries()["q1_hourly_profile_sampled"](spark, str(tmp_path)).collect()
    exact = catalog.queries()["q1_hourly_profile"](spark, str(tmp_path)).collect()
    assert len(exact) == 4 and min(r.trips for r in exact) > 1000
    assert [tuple(r) for r in found] == [(r.pickup_hour, r.trips, r.avg_duration_min, r.trips, r.p90_km) for r in exact]


def test_sketches_are_written_by_many_tasks(spark, sf_dir, monkeypatch):
    """No single task merges the sketches of all dates and hours."""
    monkeypatch.setattr(staging, "_written", {k: v for k, v in staging._written.items() if k[-1] != "profile_sketches"})
    path = mergeable_queries.sketch_table(Inputs(spark, sf_dir))
    assert spark.read.parquet(path).select(F.input_file_name()).distinct().count() > 1
