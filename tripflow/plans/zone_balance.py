"""Pickup and dropoff imbalance by zone, in a one-scan form and a full-join form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripflow.functions.values import imbalance
from tripflow.operators.filters import in_window
from tripflow.operators.joins import apply_strategy, full_outer_merge, lookup
from tripflow.operators.ranking import global_topk
from tripflow.params import TripWindow

_ATTRIBUTES = {"borough": "borough", "zone": "zone"}


def _report(counts: DataFrame, window: TripWindow) -> DataFrame:
    scored = counts.select(
        "borough",
        "zone",
        "pickups",
        "dropoffs",
        imbalance(F.col("pickups"), F.col("dropoffs")).alias("imbalance"),
    )
    order = [
        F.desc("imbalance"),
        F.desc("pickups"),
        F.desc("dropoffs"),
        F.asc_nulls_first("borough"),
        F.asc_nulls_first("zone"),
    ]
    return global_topk(scored, order, window.top_k)


def zone_imbalance(
    trips: DataFrame, zones: DataFrame, window: TripWindow, strategy: str = "auto"
) -> DataFrame:
    """One scan: each trip counts once as pickup and once as dropoff of a zone id.

    Trips whose zone is unknown have no (borough, zone) that could be equal to another, so their
    pickups and their dropoffs stay two rows; the extra grouping column keeps them apart.
    """
    ends = (
        trips.where(in_window(trips, window))
        .select(
            F.inline(
                F.array(
                    F.struct(F.col("pu_location_id").alias("id"), F.lit(True).alias("pickup")),
                    F.struct(F.col("do_location_id").alias("id"), F.lit(False).alias("pickup")),
                )
            )
        )
        .groupBy("id", "pickup")
        .agg(F.count("*").alias("n"))
    )
    named = lookup(ends, zones, "id", take=_ATTRIBUTES, how="left", strategy=strategy)
    unknown_end = F.when(F.col("borough").isNull() | F.col("zone").isNull(), F.col("pickup"))
    nothing = F.lit(0).cast("long")
    counts = named.groupBy("borough", "zone", unknown_end.alias("unknown_end")).agg(
        F.sum(F.when(F.col("pickup"), F.col("n")).otherwise(nothing)).alias("pickups"),
        F.sum(F.when(F.col("pickup"), nothing).otherwise(F.col("n"))).alias("dropoffs"),
    )
    return _report(counts, window)


def _per_zone(trips: DataFrame, zones: DataFrame, key: str, alias: str) -> DataFrame:
    counted = trips.groupBy(key).agg(F.count("*").alias("n"))
    named = lookup(counted, zones, key, take=_ATTRIBUTES, how="left")
    return named.groupBy("borough", "zone").agg(F.sum("n").alias(alias))


def zone_counts_merged(
    trips: DataFrame, zones: DataFrame, window: TripWindow, strategy: str = "auto"
) -> DataFrame:
    """Pickups per zone full-joined to dropoffs per zone; two scans."""
    kept = trips.where(in_window(trips, window))
    # Marked once for both roles, so that a size check runs once.
    places = apply_strategy(zones.select("location_id", "borough", "zone"), strategy)
    return full_outer_merge(
        _per_zone(kept, places, "pu_location_id", "pickups"),
        _per_zone(kept, places, "do_location_id", "dropoffs"),
        ["borough", "zone"],
        ["pickups", "dropoffs"],
    )


def zone_imbalance_merged(
    trips: DataFrame, zones: DataFrame, window: TripWindow, strategy: str = "auto"
) -> DataFrame:
    return _report(zone_counts_merged(trips, zones, window, strategy), window)
