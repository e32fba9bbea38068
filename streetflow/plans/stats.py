"""Trip length statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetflow.operators.quantiles import exact_quantiles, rolled_up_quantiles
from streetflow.schema import QUARTERS

GRAINS = {
    "month": ["vehicle_type", "propulsion_type", "month"],
    "month_quarter": ["vehicle_type", "propulsion_type", "month", "quart_year"],
    "vehicle": ["vehicle_type", "propulsion_type"],
}


def all_band_trips(trips: DataFrame) -> DataFrame:
    """Union of the bands without repeated rows; a trip listed in two bands counts once."""
    return trips.select(
        "trip_id", "vehicle_type", "propulsion_type", "dist_calc",
        F.month("start_time").alias("month"), "quart_year").distinct()


def trip_length_stats(trips: DataFrame, quarters: list[str] | None = None) -> DataFrame:
    """Mean and quartiles of trip length at three grains, the coarser ones added up from the finest."""
    chosen = all_band_trips(trips).filter(F.col("quart_year").isin(*(quarters or QUARTERS)))
    stats = rolled_up_quantiles(chosen, GRAINS["month_quarter"], list(GRAINS.values()), "dist_calc", [0.25, 0.5, 0.75],
                                ["p25", "p50", "p75"], mean="dist_avg")
    names = F.array(*[F.lit(n) for n in GRAINS])
    return stats.withColumn("grain", F.get(names, F.col("grain")))


def trip_length_by(trips: DataFrame, grain: str, quarters: list[str] | None = None) -> DataFrame:
    """One grain only, with just its own keys."""
    chosen = all_band_trips(trips).filter(F.col("quart_year").isin(*(quarters or QUARTERS)))
    return exact_quantiles(chosen, GRAINS[grain], "dist_calc", [0.25, 0.5, 0.75], ["p25", "p50", "p75"],
                           mean="dist_avg")
