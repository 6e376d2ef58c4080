"""Where queries are registered, with the SQL that answers the same question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripflow.catalog.views import Inputs, with_views

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def register(
    name: str, sql: str | None = None, views: tuple[str, ...] = ()
) -> Callable[[Callable[[Inputs], DataFrame]], Callable[[Inputs], DataFrame]]:
    """Register a function of ``Inputs`` under a name; ``views`` are those the SQL uses."""

    def add(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        if name in _queries:
            raise ValueError(f"query {name!r} is registered twice")
        _queries[name] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
        if sql is not None:
            _oracles[name] = with_views(sql, views)
        return build

    return add


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round columns so that engines that add doubles in another order still agree."""
    return df.withColumns({name: F.round(name, n) for name, n in digits.items()})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
