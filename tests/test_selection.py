"""Rank selection and samples against brute force, on skewed frames."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tripflow.operators.sampling import hash_sample, rate_sample, shared_hash
from tripflow.operators.selection import nearest_rank, rank_of, select_rank


def skewed(seed: int, n: int = 3000):
    """A third of the rows in one key, a third of those with one value; keys of 1 and 10 rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if i % 3 == 0 else rng.choice([1, 2, None])
        value = 7 if key == 0 and i % 9 == 0 else rng.randint(-(2**40), 2**40)
        rows.append((key, value))
    rows += [(8, 5)] + [(9, v) for v in range(10)] + [(10, None), (1, None)]
    return rows


def brute(rows, wanted):
    groups: dict = {}
    for key, value in rows:
        if value is not None:
            groups.setdefault(key, []).append(value)
    return {k: (len(v), sorted(v)[wanted(len(v)) - 1]) for k, v in groups.items()}


@pytest.mark.parametrize("few_keys", [True, False])
@pytest.mark.parametrize("fraction", [0.0, 0.5, 0.9, 1.0])
def test_select_rank(spark, few_keys, fraction):
    rows = skewed(1)
    df = spark.createDataFrame(rows, "k int, v long")
    got = select_rank(df, ["k"], "v", rank_of(fraction), 41, few_keys=few_keys).collect()
    want = brute(rows, lambda n: max(1, math.ceil(fraction * n)))
    assert {r.k: (r.rows, r.ordinal) for r in got} == want
    for r in got:
        values = [v for k, v in rows if k == r.k and v is not None]
        assert r.below == sum(v < r.ordinal for v in values)


@pytest.mark.parametrize("digit_bits", [3, 7, 18, 41, 50])
def test_any_digit_width_gives_the_same(spark, digit_bits):
    rows = skewed(2, 600)
    df = spark.createDataFrame(rows, "k int, v long")
    got = select_rank(df, ["k"], "v", rank_of(0.9), 41, few_keys=True, digit_bits=digit_bits)
    want = brute(rows, lambda n: max(1, math.ceil(0.9 * n)))
    assert {r.k: (r.rows, r.ordinal) for r in got.collect()} == want


def test_nearest_rank_of_doubles_with_totals(spark):
    rows = [(i % 2, i / 7 - 20) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, x double").withColumn("one", F.lit(1))
    got = nearest_rank(df, ["k"], "x", 0.9, 6, 40, totals={"ones": F.sum("one")}).collect()
    for r in got:
        values = sorted(round(x, 6) for k, x in rows if k == r.k)
        assert r.percentile == pytest.approx(values[math.ceil(0.9 * len(values)) - 1], abs=1e-9)
        assert r.ones == r.rows == len(values)


def test_unreadable_measures_take_no_part(spark):
    rows = [(1, float(v)) for v in range(1, 11)] + [(1, float("nan")), (1, None), (1, 1e300), (1, float("inf"))]
    df = spark.createDataFrame(rows + [(2, float("nan"))], "k int, v double")
    got = nearest_rank(df, ["k"], "v", 0.9, 6, 40, name="p").collect()
    assert [tuple(r) for r in got] == [(1, 10, 9.0)]


def test_hash_of_large_and_stepped_keys(spark):
    keys = spark.range(40_000).select((F.col("id") * 10_007 + (1 << 60)).alias("k"))
    kept = hash_sample(keys, F.col("k"), 50).count()
    assert abs(kept - 800) < 5 * math.sqrt(800)


def test_sampling_rates(spark):
    df = spark.range(50_000).withColumnRenamed("id", "k")
    n = 50_000 * 0.02
    spread = 5 * math.sqrt(n)
    assert abs(rate_sample(df).count() - n) < spread
    assert abs(hash_sample(df, F.col("k"), 50).count() - n) < spread
    hashes = df.select(shared_hash(F.col("k")).alias("h")).agg(F.min("h"), F.max("h")).first()
    assert 0 <= hashes[0] < hashes[1] < 1 << 32


def test_sketch_stays_within_its_rank_error(spark):
    n, accuracy = 20_000, 100
    df = spark.range(n).select((F.col("id") * 7919 % n).cast("double").alias("x"))
    got = df.agg(F.percentile_approx("x", 0.9, accuracy)).first()[0]
    assert abs(got - 0.9 * n) <= n / accuracy + 1
