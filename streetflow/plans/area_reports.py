"""Figures for the whole region and for a chosen set of areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetflow.functions import geometry as G
from streetflow.functions import projection as P
from streetflow.operators.areas import lines_touching, lines_within
from streetflow.plans.classify import is_divided, is_rest, is_simple_one_way
from streetflow.plans.direction import good_bicycle_trips, street_totals, trips_with_contraflow


def chosen(areas: DataFrame, names: list[str]) -> DataFrame:
    return areas.filter(F.col("municipal").isin(*names))


def network_length_by_class(ways: DataFrame, areas_lonlat: DataFrame, names: list[str]) -> DataFrame:
    """Metres of simple one-way, divided and remaining streets within the areas, in one pass.

    The areas come in degrees and are projected on read; rows are (class, network_meters).
    """
    metric = chosen(areas_lonlat, names).withColumn("rings", P.rings_to_metric(F.col("rings")))
    inside = lines_within(ways, "geom", metric).withColumn("m", G.line_length(F.col("geom")))
    classes = {"simple_one_way": is_simple_one_way(), "divided_one_way": is_divided(), "rest": is_rest()}
    sums = inside.agg(*[F.sum(F.when(match, F.col("m"))).alias(name) for name, match in classes.items()])
    return sums.unpivot([], list(classes), "class", "network_meters")


def area_trips(trips: DataFrame, areas: DataFrame, names: list[str]) -> DataFrame:
    """Distinct (trip_id, dist_calc) of good bicycle trips that touch one of the areas."""
    return lines_touching(
        good_bicycle_trips(trips), "geom", ["trip_id", "dist_calc"], chosen(areas, names)
    ).select("trip_id", "dist_calc").distinct()


def area_metres(touching: DataFrame) -> DataFrame:
    """Metres and trips; a trip listed with two lengths counts with both."""
    return touching.agg(F.sum("dist_calc").alias("total_m"), F.count_distinct("trip_id").alias("trips"))


def area_contraflow_share(touching: DataFrame, segments: DataFrame, ways: DataFrame) -> DataFrame:
    """Trips in the areas, and how many of them ride against a simple one-way street anywhere."""
    wrong = trips_with_contraflow(segments, ways).withColumn("wrong", F.lit(1))
    per_trip = touching.select("trip_id").distinct().join(wrong, "trip_id", "left")
    return per_trip.agg(
        F.count("trip_id").alias("trips"), F.count("wrong").alias("contraflow_trips"),
        F.try_divide(F.count("wrong"), F.count("trip_id")).alias("share"))


def contraflow_metres(segments: DataFrame, ways: DataFrame, areas: DataFrame, names: list[str]) -> DataFrame:
    """Contraflow metres on simple one-way streets: everywhere, and on those touching the areas."""
    simple = ways.filter(is_simple_one_way())
    touching = lines_touching(simple, "geom", ["osm_id"], chosen(areas, names)).select("osm_id").distinct()
    totals = (
        street_totals(segments, ways)
        .join(simple.select("osm_id"), "osm_id", "left_semi")
        .join(touching.withColumn("in_area", F.lit(True)), "osm_id", "left"))
    return totals.agg(
        F.sum("tot_m_contra").alias("contraflow_m"),
        F.sum(F.when(F.col("in_area"), F.col("tot_m_contra"))).alias("contraflow_m_in_areas"))
