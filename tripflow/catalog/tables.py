"""Table functions: in SQL text over views, with a table argument and in a lateral join."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripflow.catalog.jobs import _BEST_DAYS as BEST_DAYS_SQL
from tripflow.catalog.jobs import W
from tripflow.catalog.registry import register, rounded
from tripflow.catalog.views import Inputs
from tripflow.functions.tables import register_table_functions
from tripflow.plans.best_days import daily_tips

_DAILY = """
WITH daily AS (
  SELECT vendor_id, CAST(pickup_ts AS DATE) AS pickup_date, round(sum(total_amount), 2) AS revenue
  FROM trips_zone GROUP BY 1, 2
)"""


@register("q2_best_days_table_function", BEST_DAYS_SQL, ("trips_geo",))
def _best_days(t: Inputs):
    """Top K dates of a vendor, read from its ordered days by a table function."""
    register_table_functions(t.spark)
    daily = daily_tips(t["trips_geo"], W)
    best = t.spark.sql(
        """SELECT vendor_id, pickup_date, avg_tip_per_distance FROM best_rows(
             TABLE(SELECT vendor_id, pickup_date, avg_tip_per_distance FROM {daily})
             PARTITION BY vendor_id ORDER BY (avg_tip_per_distance DESC, pickup_date), :k)""",
        args={"k": W.top_k}, daily=daily,
    )
    return rounded(best, avg_tip_per_distance=6)


@register(
    "rising_runs",
    f"""{_DAILY},
        marked AS (
          SELECT *, CASE WHEN revenue > lag(revenue) OVER (PARTITION BY vendor_id ORDER BY pickup_date) THEN 0 ELSE 1 END AS new
          FROM daily WHERE revenue IS NOT NULL),
        runs AS (SELECT *, sum(new) OVER (PARTITION BY vendor_id ORDER BY pickup_date) AS run FROM marked)
        SELECT vendor_id, min(pickup_date) AS start, max(pickup_date) AS stop, count(*) AS length,
               round(max(revenue) - min(revenue), 2) AS gain
        FROM runs GROUP BY vendor_id, run""",
    ("trips_zone",),
)
def _rising(t: Inputs):
    register_table_functions(t.spark)
    daily = t["trips_zone"].groupBy("vendor_id", F.to_date("pickup_ts").alias("pickup_date")).agg(
        F.round(F.sum("total_amount"), 2).alias("revenue")
    )
    runs = t.spark.sql(
        "SELECT * FROM rising_runs(TABLE(SELECT vendor_id, pickup_date, revenue FROM {daily}) PARTITION BY vendor_id ORDER BY pickup_date)",
        daily=daily,
    )
    return rounded(runs, gain=2)


@register(
    "lateral_table_function",
    """WITH hours AS (
         SELECT location_id, zone, unnest(range(location_id % 24, location_id % 24 + 4)) AS h FROM zones)
       SELECT zone, CAST(h % 24 AS INT) AS pickup_hour, CAST(h // 24 AS INT) AS day_shift, count(trip_id) AS trips
       FROM hours LEFT JOIN trips_zone ON pu_location_id = location_id AND hour(pickup_ts) = h % 24
       GROUP BY ALL""",
    ("trips_zone", "zones"),
)
def _lateral(t: Inputs):
    """A window of hours for every zone by a lateral join, then the trips of each; zeros included."""
    register_table_functions(t.spark)
    return t.spark.sql(
        """WITH counted AS (
             SELECT pu_location_id, hour(pickup_ts) AS h, count(*) AS n FROM {trips} GROUP BY ALL)
           SELECT zone, w.hour AS pickup_hour, day_shift, coalesce(n, 0L) AS trips
           FROM {zones}, LATERAL window_hours(location_id % 24, 4) w
           LEFT JOIN counted ON pu_location_id = location_id AND h = w.hour""",
        trips=t["trips_zone"], zones=t["zones"].withColumn("location_id", F.col("location_id").cast("int")),
    )
