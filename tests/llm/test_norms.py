"""Nearest neighbours by inner product where vectors differ in length, and ids repeat."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripflow.llm import vamana


def _recall(spark, vectors, queries):
    """Recall of the 20 nearest through the whole operator; query ids are those below ``queries``."""
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    valid = vamana.valid_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = vamana.nearest(valid, valid.where(F.col("vec_id") < queries), 20).collect()
    got = {q: set() for q in range(queries)}
    for r in found:
        got[r.query_id].add(r.vec_id)
        assert np.isclose(r.score, vectors[r.query_id] @ vectors[r.vec_id], rtol=1e-12)
    hits = 0
    for q in range(queries):
        score = vectors @ vectors[q]
        score[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-score, kind="stable")[:20].tolist()))
        assert len(got[q]) == 20
    return hits / (20 * queries)


def _unit(rng, n, dim):
    v = rng.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1)[:, None]


@pytest.mark.parametrize("deviation", [0.0, 0.5, 1.0, 1.5])
def test_lengths_spread_log_normally(spark, deviation):
    rng = np.random.default_rng(7)
    vectors = _unit(rng, 4096, 64) * np.exp(rng.normal(0, deviation, 4096))[:, None]
    assert _recall(spark, vectors, 60) >= 0.9


@pytest.mark.parametrize("longest", [1e3, 1e4, 1e30, 1e200])
def test_a_single_long_vector(spark, longest):
    rng = np.random.default_rng(8)
    vectors = _unit(rng, 2048, 32)
    vectors[777] *= longest
    assert _recall(spark, vectors, 60) >= 0.9


def test_shards_are_dealt_evenly(spark):
    rng = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(_unit(rng, 3000, 8))]
    valid = vamana.valid_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    graphs = vamana.build_index(valid, 5, shard=300)
    assert sorted(r.number for r in graphs.select("number").collect()) == list(range(11))
    by_task = graphs.groupBy(F.input_file_name()).count().collect()
    assert len(by_task) == 11 and {r["count"] for r in by_task} == {1}


def test_rows_that_share_an_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.9, 0.1]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.4, 0.1]), (2, [1.0, 0.0]), (3, [-0.0, 2.0]), (4, [0.0, 2.0])]
    valid = vamana.valid_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert valid.count() == 7
    found = vamana.nearest(valid, valid.where("vec_id = 0"), 20)
    got = sorted((r["rank"], r.vec_id, round(r.score, 6)) for r in found.collect())
    # Two queries of id 0: each has the other among its candidates.
    one = [(1, 2, 1.0), (2, 0, 0.9), (3, 1, 0.5), (4, 1, 0.4), (5, 3, 0.0), (6, 4, 0.0)]
    two = [(1, 0, 0.9), (2, 2, 0.9), (3, 1, 0.5), (4, 1, 0.37), (5, 3, 0.2), (6, 4, 0.2)]
    assert got == sorted(one + two)
