"""Share of surcharges in revenue by vendor and service zone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripflow.functions.values import null_to_zero
from tripflow.operators.filters import in_window
from tripflow.operators.joins import lookup
from tripflow.params import TripWindow


def revenue_share(
    trips: DataFrame, zones: DataFrame, window: TripWindow, strategy: str = "auto"
) -> DataFrame:
    """Sums per (vendor, zone id), then the lookup, then service zones."""
    surcharges = null_to_zero(F.col("congestion_surcharge")) + null_to_zero(F.col("airport_fee"))
    per_zone = (
        trips.where(in_window(trips, window))
        .groupBy("vendor_id", "pu_location_id")
        .agg(
            F.count("*").alias("n"),
            F.sum(null_to_zero(F.col("total_amount"))).alias("revenue"),
            F.sum(surcharges).alias("surcharges"),
        )
    )
    revenue, extra = F.col("total_revenue"), F.col("surcharge_revenue")
    return (
        lookup(per_zone, zones, "pu_location_id", take={"service_zone": "service_zone"},
               strategy=strategy)
        .groupBy("vendor_id", "service_zone")
        .agg(
            F.sum("n").alias("trips"),
            F.sum("revenue").alias("total_revenue"),
            F.sum("surcharges").alias("surcharge_revenue"),
        )
        .withColumn("surcharge_share", F.when(revenue > 0, extra / revenue).otherwise(F.lit(0.0)))
        .withColumn("revenue_per_trip", revenue / F.col("trips"))
        .orderBy("vendor_id", "service_zone")
    )
