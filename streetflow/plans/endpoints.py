"""Matched start and end points, and straight-line distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetflow.functions import geometry as G
from streetflow.functions import projection as P
from streetflow.functions import text as T
from streetflow.plans.direction import good_bicycle_trips


def with_matched_points(trips: DataFrame) -> DataFrame:
    """``matched_start`` / ``matched_end``: line ends in degrees."""
    ends = {"matched_start": G.start_point(F.col("geom")), "matched_end": G.end_point(F.col("geom"))}
    return trips.withColumns({n: P.to_lonlat(p["x"], p["y"]) for n, p in ends.items()})


def trip_endpoints(trips: DataFrame) -> DataFrame:
    """Good bicycle trips with both ends as WKT; the filter runs before any projection work."""
    return with_matched_points(good_bicycle_trips(trips)).select(
        "trip_id", "band", "dist_calc", "od_line_dist", "geom", "matching_error", "propulsion_type",
        T.point_wkt(F.col("matched_start")).alias("matched_start"),
        T.point_wkt(F.col("matched_end")).alias("matched_end"))


def od_line_distance(trips: DataFrame) -> DataFrame:
    """``od_line_dist``: metres between the projected origin and destination."""
    o = P.to_metric(F.col("lon_o"), F.col("lat_o"))
    d = P.to_metric(F.col("lon_d"), F.col("lat_d"))
    return trips.withColumn("od_line_dist", G.distance(o, d))


def parse_endpoints(table: DataFrame) -> DataFrame:
    """WKT text ends back to lon/lat doubles."""
    o, d = T.parse_point_wkt(F.col("matched_start")), T.parse_point_wkt(F.col("matched_end"))
    return table.withColumns({
        "lon_o": o["x"], "lat_o": o["y"], "lon_d": d["x"], "lat_d": d["y"]})
