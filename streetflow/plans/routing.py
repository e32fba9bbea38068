"""Shortest network path of every trip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetflow.functions import projection as P
from streetflow.operators.graph import shortest_paths
from streetflow.operators.storage import cut_lineage

# Road classes a bicycle route may not use.
CLOSED_TO_ROUTING = ["motorway", "motorway_link"]


def routable(ways: DataFrame) -> DataFrame:
    """Roads of any class but motorways, all equally preferred."""
    return ways.filter(F.col("highway").isNotNull() & ~F.col("highway").isin(*CLOSED_TO_ROUTING))


def model_routes(trips: DataFrame, ways: DataFrame) -> DataFrame:
    """``trips`` with lon/lat ends, plus f_distance, f_line (metres), route_status and dist_ratio.

    Equal origin/destination pairs are routed once. Trips without a complete pair keep NULLs and the
    status ``no_endpoints``.
    """
    o = P.to_metric(F.col("lon_o"), F.col("lat_o"))
    d = P.to_metric(F.col("lon_d"), F.col("lat_d"))

    def mm(c):
        return F.round(c, 3)

    placed = trips.withColumns({"_o": o, "_d": d}).withColumns({
        "ox": mm(F.col("_o.x")), "oy": mm(F.col("_o.y")), "dx": mm(F.col("_d.x")), "dy": mm(F.col("_d.y")),
    }).drop("_o", "_d")
    # written first: a filter would be pushed below the projections and repeat them within each other
    complete = cut_lineage(placed.select("ox", "oy", "dx", "dy").distinct(), "ends").na.drop()
    found = shortest_paths(complete, routable(ways))
    joined = placed.join(found, ["ox", "oy", "dx", "dy"], "left")
    return joined.withColumn("dist_ratio", F.try_divide("dist_calc", "f_distance")).withColumn(
        "route_status", F.coalesce("route_status", F.lit("no_endpoints"))).drop("ox", "oy", "dx", "dy")
