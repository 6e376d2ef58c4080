"""Strongest borough-to-borough flows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripflow.operators.filters import in_window, present
from tripflow.operators.joins import apply_strategy, lookup
from tripflow.operators.ranking import global_topk
from tripflow.params import TripWindow


def borough_flows(
    trips: DataFrame, zones: DataFrame, window: TripWindow, strategy: str = "auto"
) -> DataFrame:
    """Top K pairs of different boroughs by number of trips, on days that every month has.

    Trips are counted per pair of zone ids before the lookups: what reaches the joins is at most
    one row per pair of zones, so a hot zone cannot skew them under any join strategy.
    """
    window = replace(window, common_days=True)
    pairs = (
        trips.where(in_window(trips, window) & present("pu_location_id", "do_location_id"))
        .groupBy("pu_location_id", "do_location_id")
        .agg(F.count("*").alias("pair_trips"))
    )
    # Marked once for both roles, so that a size check runs once.
    boroughs = apply_strategy(zones.select("location_id", "borough"), strategy)
    named = lookup(pairs, boroughs, "pu_location_id", take={"borough": "pickup_borough"})
    named = lookup(named, boroughs, "do_location_id", take={"borough": "dropoff_borough"})
    flows = (
        named.where(
            present("pickup_borough", "dropoff_borough")
            & (F.col("pickup_borough") != F.col("dropoff_borough"))
        )
        .groupBy("pickup_borough", "dropoff_borough")
        .agg(F.sum("pair_trips").alias("trips"))
    )
    order = [F.desc("trips"), F.asc("pickup_borough"), F.asc("dropoff_borough")]
    return global_topk(flows, order, window.top_k)
