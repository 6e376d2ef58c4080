from __future__ import annotations

import contextlib
import io
import os

import pytest

from tripflow.catalog.views import Inputs
from tripflow.session import local_session

SF_DIR = os.environ.get("TRIPFLOW_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(os.environ.get("TRIPFLOW_CPUS", "8"), app="tripflow-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def inputs(spark, sf_dir):
    return Inputs(spark, sf_dir)


@pytest.fixture(scope="session")
def geo(inputs):
    return inputs["trips_geo"]


@pytest.fixture(scope="session")
def zone_trips(inputs):
    return inputs["trips_zone"]


@pytest.fixture(scope="session")
def zones(inputs):
    return inputs["zones"]


@pytest.fixture
def plan():
    """The physical plan of a frame as text."""

    def text(df, mode: str = "simple") -> str:
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            df.explain(mode)
        return out.getvalue()

    return text


@pytest.fixture
def rows():
    """All rows as sorted plain tuples."""

    def plain(df, *columns: str):
        chosen = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in chosen.collect()), key=str)

    return plain
