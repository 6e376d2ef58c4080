"""Column builders: no jobs run here, every function returns a Column or a UDF."""

from tripflow.functions.geo import haversine_arrow_udf, haversine_km, haversine_udf
from tripflow.functions.times import (
    duration_minutes,
    hour_in_zone,
    normalise_iso,
    parse_timestamp,
    whole_seconds,
)
from tripflow.functions.values import (
    imbalance,
    null_to_zero,
    safe_ratio,
    tolerant_double,
    tolerant_int,
)

__all__ = [
    "duration_minutes",
    "haversine_arrow_udf",
    "haversine_km",
    "haversine_udf",
    "hour_in_zone",
    "imbalance",
    "normalise_iso",
    "null_to_zero",
    "parse_timestamp",
    "safe_ratio",
    "tolerant_double",
    "tolerant_int",
    "whole_seconds",
]
