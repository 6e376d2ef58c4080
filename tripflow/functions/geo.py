"""Great-circle distance, as a built-in expression and as two Python forms to compare with it."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Fixed value: mean earth radius in km.
EARTH_RADIUS_KM = 6371.0
# No two points are further apart than half the circumference (about 20,015.1 km). Distances in
# steps of 1e-6 km therefore fit into 35 bits.
KM_DECIMALS = 6
KM_ORDINAL_BITS = 35


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in km from built-in functions only, so it stays inside generated code.

    Null where a coordinate is null or NaN.

    The arcsine argument is clamped to 1: rounding can lift it above for antipodal points, which
    would give NaN. (``least`` would do, but it skips nulls and turns a missing point into 1.)
    """
    across = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0))
    along = F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    chord = across + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * along
    # NaN is greater than 1 to Spark: it has to become null before the clamp.
    clamped = F.when(~F.isnan(chord), F.when(chord > 1, F.lit(1.0)).otherwise(chord))
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(clamped))


def _haversine_row(lat1, lon1, lat2, lon2):
    corners = (lat1, lon1, lat2, lon2)
    if any(corner is None or corner == 0 or math.isnan(corner) for corner in corners):
        return None
    phi1, lam1, phi2, lam2 = map(math.radians, corners)
    chord = (
        math.sin((phi2 - phi1) / 2) ** 2
        + math.cos(phi1) * math.cos(phi2) * math.sin((lam2 - lam1) / 2) ** 2
    )
    return 2.0 * EARTH_RADIUS_KM * math.asin(math.sqrt(min(1.0, chord)))


def _haversine_batch(
    lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series
) -> pd.Series:
    degrees = np.stack([np.asarray(s, dtype="float64") for s in (lat1, lon1, lat2, lon2)])
    phi1, lam1, phi2, lam2 = np.radians(degrees)
    chord = (
        np.sin((phi2 - phi1) / 2) ** 2
        + np.cos(phi1) * np.cos(phi2) * np.sin((lam2 - lam1) / 2) ** 2
    )
    km = 2.0 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(1.0, chord)))
    usable = ~np.isnan(degrees).any(axis=0) & (degrees != 0).all(axis=0)
    return pd.Series(km).where(usable, None)


def haversine_udf(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Python form called per row, fed in Arrow batches; null where a coordinate is null, NaN or
    zero. Kept for comparison."""
    return F.udf(_haversine_row, DoubleType(), useArrow=True)(lat1, lon1, lat2, lon2)


def haversine_arrow_udf(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Arrow-batched Python form with the same result as ``haversine_udf``."""
    return F.pandas_udf(_haversine_batch, DoubleType())(lat1, lon1, lat2, lon2)
