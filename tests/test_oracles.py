"""Every registered query against its SQL in DuckDB, on the same tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from tripflow import catalog
from tests.oracle import compare, connect

ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    if name in ORACLES:
        assert compare(df, duck, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_all_queries_have_sql():
    assert set(catalog.queries()) == set(ORACLES)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
