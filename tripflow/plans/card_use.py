"""Card use by pickup borough: trips, share paid by card, mean tip rate of card trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripflow.functions.values import safe_ratio
from tripflow.operators.filters import in_window
from tripflow.operators.joins import lookup
from tripflow.params import TripWindow

CARD = 1  # fixed value: the payment type that means card


def card_use(
    trips: DataFrame, zones: DataFrame, window: TripWindow, strategy: str = "auto"
) -> DataFrame:
    """Sums per zone id first, then the lookup, then boroughs: a hot zone is one row by then."""
    by_card = F.col("payment_type") == CARD
    tip_rate = F.when(
        by_card & (F.col("fare_amount") > 0), F.col("tip_amount") / F.col("fare_amount")
    )
    per_zone = (
        trips.where(in_window(trips, window))
        .groupBy("pu_location_id")
        .agg(
            F.count("*").alias("n"),
            F.count(F.when(by_card, 1)).alias("n_card"),
            F.sum(tip_rate).alias("rate_sum"),
            F.count(tip_rate).alias("n_rate"),
        )
    )
    return (
        lookup(per_zone, zones, "pu_location_id", take={"borough": "pickup_borough"},
               strategy=strategy)
        .groupBy("pickup_borough")
        .agg(
            F.sum("n").alias("trips"),
            (F.sum("n_card") / F.sum("n")).alias("card_share"),
            safe_ratio(F.sum("rate_sum"), F.sum("n_rate")).alias("avg_tip_rate_card"),
        )
        .orderBy(F.desc("avg_tip_rate_card"), "pickup_borough")
    )


# Card trips count as 1, so that a mean is the share; rates are of card trips with a fare only.
_SQL = """
SELECT borough AS pickup_borough, count(*) AS trips,
       avg(IF(payment_type = :card, 1D, 0D)) AS card_share,
       avg(try_divide(tip_amount, fare_amount)) FILTER (WHERE payment_type = :card AND fare_amount > 0)
         AS avg_tip_rate_card
FROM {kept} JOIN {zones} ON location_id = pu_location_id
GROUP BY borough
ORDER BY avg_tip_rate_card DESC, pickup_borough
"""


def card_use_sql(trips: DataFrame, zones: DataFrame, window: TripWindow) -> DataFrame:
    """The report as SQL text over the trips of the window and the zone lookup."""
    kept = trips.where(in_window(trips, window))
    return trips.sparkSession.sql(_SQL, args={"card": CARD}, kept=kept, zones=zones)
