"""Best tip days per vendor: mean tip per distance per (vendor, date), K best dates each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripflow.functions.values import safe_ratio
from tripflow.operators.filters import in_hours, positive, present
from tripflow.operators.ranking import topk_dates_collected, topk_per_group, topk_two_level
from tripflow.params import TripWindow

MEASURE = "avg_tip_per_distance"


def _order() -> list[Column]:
    return [F.desc(MEASURE), F.asc("pickup_date")]


def rated_trips(trips: DataFrame, window: TripWindow) -> DataFrame:
    """Trips that count: paid, of some distance, with vendor and tip, in the window's hours."""
    return trips.where(
        present("vendor_id", "pickup_ts", "tip_amount")
        & positive("trip_distance", "fare_amount")
        & in_hours(F.col("pickup_ts"), window)
    )


def daily_tips(trips: DataFrame, window: TripWindow) -> DataFrame:
    """Mean tip per distance by vendor and date."""
    return (
        rated_trips(trips, window)
        .groupBy("vendor_id", F.to_date("pickup_ts").alias("pickup_date"))
        .agg(F.avg(safe_ratio(F.col("tip_amount"), F.col("trip_distance"))).alias(MEASURE))
    )


def _report(ranked: DataFrame) -> DataFrame:
    return ranked.select("vendor_id", "pickup_date", MEASURE).orderBy("vendor_id", *_order())


def best_days(trips: DataFrame, window: TripWindow) -> DataFrame:
    return _report(
        topk_per_group(daily_tips(trips, window), ["vendor_id"], _order(), window.top_k)
    )


def best_days_two_level(trips: DataFrame, window: TripWindow) -> DataFrame:
    return _report(
        topk_two_level(
            daily_tips(trips, window), ["vendor_id"], _order(), F.col("pickup_date"), window.top_k
        )
    )


def best_days_collected(trips: DataFrame, window: TripWindow) -> DataFrame:
    return _report(
        topk_dates_collected(
            daily_tips(trips, window), "vendor_id", "pickup_date", MEASURE, window.top_k
        )
    )


# Ranks over the aggregate in the same select; the trips come filtered by the shared predicates.
_SQL = """
FROM {trips}
|> AGGREGATE avg(try_divide(tip_amount, trip_distance)) AS avg_tip_per_distance
   GROUP BY vendor_id, to_date(pickup_ts) AS pickup_date
|> EXTEND row_number() OVER (
     PARTITION BY vendor_id ORDER BY avg_tip_per_distance DESC, pickup_date) AS rank
|> WHERE rank <= :k
|> DROP rank
|> ORDER BY vendor_id, avg_tip_per_distance DESC, pickup_date
"""


def best_days_sql(trips: DataFrame, window: TripWindow) -> DataFrame:
    spark = trips.sparkSession
    return spark.sql(_SQL, args={"k": window.top_k}, trips=rated_trips(trips, window))
