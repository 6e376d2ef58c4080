"""Hard negatives against scoring every pair."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import CLASH
from tripflow.llm import hard_negatives

_SCHEMA = "vec_id long, embedding array<double>, label int"


def _plain(rows):
    """The same by brute force over Python's integers; ids are distinct."""
    taken = []
    for k, v, label in rows:
        if k is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            taken.append((k, label, [math.floor(256 * x) for x in v]))
    out = []
    for k, label, v in taken:
        if k % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), i, other) for i, other, w in taken if len(w) == len(v) and i != k]
        for minus, p, _ in sorted(s for s in scored if s[2] == label)[:5]:
            low = sorted(s for s in scored if s[2] != label and 80 * -minus <= 100 * -s[0] <= 100 * -minus)[:5]
            out += [(k, p, -minus, rank, n, -s) for rank, (s, n, _) in enumerate(low, 1)]
    return sorted(out)


def _found(frame):
    rows = hard_negatives.mine(frame, F.col("vec_id") % 100 == 0).collect()
    return sorted((r.anchor_id, r.positive_id, r.positive_score, r["rank"], r.negative_id, r.negative_score) for r in rows)


def _cloud(rng, n, dim, spread, label_of):
    centres = np.random.default_rng(rng.randrange(99)).normal(size=(4, dim))
    out = []
    for k in range(n):
        v = centres[k % 4] + np.array([rng.gauss(0, 0.7) for _ in range(dim)])
        v = v / np.linalg.norm(v) * math.exp(rng.gauss(0, spread))
        out.append((k * 10, v.tolist(), label_of(k)))
    return out


@pytest.mark.parametrize("spread", [0.0, 0.5, 1.5])
@pytest.mark.parametrize("rows", [30, 4096])
def test_against_all_pairs(spark, monkeypatch, spread, rows):
    """Lengths alike and spread, buckets and blocks small and large, hard negatives and ties."""
    monkeypatch.setattr(hard_negatives, "BUCKET_ROWS", rows)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", max(4, rows // 6))
    rng = random.Random(int(spread * 10))
    data = _cloud(rng, 400, 12, spread, lambda k: (k % 4 + (k % 7 == 0)) % 5)
    data += [(k * 10 + 5, v, label + 1) for k, (_, v, label) in enumerate(data[:40])]  # equal vectors, other label
    assert _found(spark.createDataFrame(data, _SCHEMA)) == _plain(data) != []


def test_low_dimension_prunes(spark):
    """Few dimensions and high scores: most rows fall out by their coordinates."""
    rng = random.Random(8)
    data = []
    for k in range(600):
        a = rng.choice([0.1, 0.2, 2.0, 4.0]) + rng.gauss(0, 0.05)
        data.append((k, [math.cos(a), math.sin(a), rng.gauss(0, 0.02)], k % 3))
    assert _found(spark.createDataFrame(data, _SCHEMA)) == _plain(data) != []
    side = {
        "keys": np.arange(600).tobytes(), "labels": np.zeros(600, np.int64).tobytes(), "longest": 256.0, "dim": 3, "targets": b"",
        "vectors": (256 * np.array([v for _, v, _ in data])).tobytes(), "lengths": np.full(600, 256.0).tobytes(),
    }
    bucket = hard_negatives.Bucket(side)
    some = bucket.candidates(bucket.vectors[0], 256.0, 0.9 * 256**2)
    scores = bucket.vectors @ bucket.vectors[0]
    assert set(np.flatnonzero(scores >= 0.9 * 256**2)) <= set(some.tolist()) and len(some) < 450
    assert len(bucket.candidates(bucket.vectors[0], 256.0, 1.1 * 256**2)) == 0


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.99, 0.1], 2), (3, None, 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1),
        (6, [None, 1.0], 1), (7, [], 1), (None, [1.0, 1.0], 1), (8, [0.0, 0.0], 1), (9, [0.9, 0.0], 2), (10, [1.0, 0.0], None),
        (100, [0.0, 0.0], 3), (101, [0.0, 0.0], 3), (102, [0.0, 1.0], 4), (200, [], 3), (201, [], 3), (202, [], 5),
        (300, [1.0, 2.0, 3.0], 1), (400, [-1.0, 0.5], 6), (401, [1.0, -0.25], 6), (402, [0.3, -3.0], 7), (11, [0.9, 0.0], 2),
        (500, [-0.001, 0.001], 8), (501, [0.001, 0.001], 8),
    ]
    frame = spark.createDataFrame(data, _SCHEMA)
    want = _plain(data)
    assert want and _found(frame) == want
    assert _found(frame.unionByName(frame)) == want  # repeated rows count once
    wide = frame.select("*", *[F.lit("x").alias(c) for c in [*CLASH, "vector", "length", "dim", "group", "targets", "rank"]])
    assert _found(wide) == want
    assert _found(frame.limit(0)) == [] and _found(frame.where("vec_id % 100 <> 0")) == []


def test_large_components_are_exact(spark):
    """Scores that a double could not tell apart, but a long can."""
    data = [(0, [4e6, 1.0], 1), (1, [4e6, 2.0], 1), (2, [4e6, 1.5], 2), (3, [4e6, 1.99], 2), (4, [3.5e6, 7.0], 2), (5, [1.0, 1.0], 2)]
    want = _plain(data)
    assert _found(spark.createDataFrame(data, _SCHEMA)) == want != []
    assert float(want[0][2]) == float(want[0][2] - 1)


def test_scores_beyond_a_long_are_clipped(spark):
    most = 2**63 - 1
    data = [(0, [3e38], 1), (1, [2e38], 1), (2, [3e38], 2), (3, [1e298], 2), (5, [1e300], 2), (4, [-3e38], 2)]
    assert _found(spark.createDataFrame(data, _SCHEMA)) == [(0, 1, most, 1, 2, most), (0, 1, most, 2, 3, most)]


def test_a_key_of_many_rows(spark):
    """Rows that share a key are rows of their own and are dealt by their whole content."""
    data = [(0, [1.0, 0.0], 1), (7, [0.9, 0.1], 1)] + [(8, [0.8 + k / 1000, 0.2], 2) for k in range(50)]
    rows = hard_negatives.mine(spark.createDataFrame(data, _SCHEMA), F.col("vec_id") % 100 == 0).collect()
    assert [(r.anchor_id, r.positive_id, r["rank"], r.negative_id) for r in sorted(rows, key=lambda r: r["rank"])] == [(0, 7, i, 8) for i in range(1, 6)]
