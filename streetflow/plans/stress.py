"""Metres of each trip on each traffic-stress class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetflow.functions import geometry as G
from streetflow.operators.overlap import AREA_DIGITS, overlap, overlap_regions
from streetflow.plans.classify import ridden
from streetflow.schema import OVERLAP_MIN_M2, STRESS_CLASSES

AREAS = [f"area_{c}" for c in STRESS_CLASSES] + ["area_other"]


def overlap_trip_street(trips: DataFrame, ways: DataFrame, **options) -> DataFrame:
    """One row per trip and street whose buffers meet, on the ridden network."""
    return overlap(trips, ridden(ways), **options)


def of_trip(df: DataFrame) -> list[str]:
    """The columns that name a trip; those of saved tables include the one they are bucketed by."""
    return [c for c in ("band", "trip_id", "trip_key") if c in df.columns]


def dissolve(overlaps: DataFrame) -> DataFrame:
    """Merge rows of a trip that have the same region and class.

    The region counts once, while ``sum_seg_area`` adds up every street that has it.
    """
    return overlaps.groupBy(*of_trip(overlaps), "shape", "stress_lev").agg(
        F.max("seg_area").alias("area"), F.round(F.sum("seg_area"), AREA_DIGITS).alias("sum_seg_area"))


def dissolved_parts(trips: DataFrame, ways: DataFrame, **options) -> DataFrame:
    """``dissolve`` as geometry: one row per connected part of every distinct region of a trip and class.

    The outlines themselves are the grouping key, so different regions never merge. ``part`` counts from 0, lowest first.
    """
    regions = overlap_regions(trips, ridden(ways), **options)
    rings = F.transform("parts", lambda p: p["rings"])
    merged = regions.withColumn("region", rings).groupBy("band", "trip_id", "stress_lev", "region").agg(
        F.max("parts").alias("parts"), F.round(F.sum("seg_area"), AREA_DIGITS).alias("sum_seg_area"))
    dumped = merged.select("band", "trip_id", "stress_lev", "sum_seg_area", F.posexplode("parts").alias("part", "p"))
    return dumped.select(
        "band", "trip_id", "stress_lev", "part", F.col("p.rings").alias("rings"),
        F.round("p.area", AREA_DIGITS).alias("area"), F.round("p.ring_m", AREA_DIGITS).alias("ring_m"), "sum_seg_area")


def area_by_class(overlaps: DataFrame) -> DataFrame:
    """One pass of conditional sums instead of one table per class; thin overlaps are crossings."""
    parts = dissolve(overlaps).filter(F.col("sum_seg_area") > OVERLAP_MIN_M2)

    def total(match: Column) -> Column:
        return F.round(F.sum(F.when(match, F.col("area"))), AREA_DIGITS)

    level = F.col("stress_lev")
    return parts.groupBy(*of_trip(parts)).agg(
        *[total(level == c).alias(f"area_{c}") for c in STRESS_CLASSES],
        total(level.isNull()).alias("area_other"))


def _lengths(df: DataFrame, length: str) -> DataFrame:
    """Areas to metres through the average overlap width; no width where the trip has no length."""
    d = F.col(length)
    total = sum((F.coalesce(F.col(a), F.lit(0.0)) for a in AREAS[1:]), F.coalesce(F.col(AREAS[0]), F.lit(0.0)))
    with_width = df.withColumn("area", total).withColumn("width_avg", F.when(d > 0, F.col("area") / d))
    width = F.nullif(F.col("width_avg"), F.lit(0.0))
    return with_width.select("*", *[(F.col(f"area_{c}") / width).alias(f"len_{c}") for c in STRESS_CLASSES])


def stress_area_by_trip(trips: DataFrame, ways: DataFrame, **options) -> DataFrame:
    """Trips with their class areas; trips that meet no street keep NULLs."""
    areas = area_by_class(overlap_trip_street(trips, ways, named=False, **options))
    return trips.join(areas, ["band", "trip_id"], "left")


def saved_stress_area(saved_trips: DataFrame, saved_overlaps: DataFrame) -> DataFrame:
    """``stress_area_by_trip`` from saved tables: neither of them is shuffled."""
    areas = area_by_class(saved_overlaps).drop("band", "trip_id")
    return saved_trips.join(areas, "trip_key", "left")


def _typed(trips: DataFrame) -> DataFrame:
    return trips.withColumn("dist_calc", F.col("dist_calc").cast("double"))


def _measured(routes: DataFrame) -> DataFrame:
    return routes.withColumn("sh_net_dist_calc", G.line_length(F.col("geom")))


def stress_len_by_trip(trips: DataFrame, ways: DataFrame, **options) -> DataFrame:
    return _lengths(stress_area_by_trip(_typed(trips), ways, **options), "dist_calc").select(
        "trip_id", "band", "geom", "vehicle_type", "propulsion_type", "dist_calc", "matching_error", "start_time",
        *AREAS, "area", "width_avg", *[f"len_{c}" for c in STRESS_CLASSES])


def stress_len_shortest(routes: DataFrame, ways: DataFrame, **options) -> DataFrame:
    """The same for modelled paths, whose length is that of their line."""
    return _lengths(stress_area_by_trip(_measured(routes), ways, **options), "sh_net_dist_calc").select(
        "trip_id", "band", "geom", "sh_net_dist_calc", "dist_ratio",
        *AREAS, "area", "width_avg", *[f"len_{c}" for c in STRESS_CLASSES])


def pair(actual: DataFrame, shortest: DataFrame) -> DataFrame:
    """Actual against shortest: one row per modelled path, actual columns NULL without a trip; metres as far as there."""
    metres, sh_metres = ([f"len_{c}" for c in STRESS_CLASSES if f"len_{c}" in side.columns] for side in (actual, shortest))
    left = shortest.select(
        "band", "trip_id", "sh_net_dist_calc", "dist_ratio", *[F.col(c).alias(f"sh_{c}") for c in sh_metres])
    right = actual.select(
        "band", F.col("trip_id").alias("_id"), "geom", "propulsion_type", "dist_calc", "start_time", *metres)
    joined = left.withColumn("_id", F.col("trip_id")).join(right, ["band", "_id"], "left")
    return joined.select(
        F.when(F.col("dist_calc").isNotNull() | F.col("geom").isNotNull(), F.col("trip_id")).alias("trip_id"),
        "band", "geom", "propulsion_type", "dist_calc", "start_time",
        *metres, "sh_net_dist_calc", "dist_ratio", *[f"sh_{c}" for c in sh_metres])


def stress_len_pair(trips: DataFrame, routes: DataFrame, ways: DataFrame, sides: tuple[str, ...] = ("actual", "shortest"),
                    **options) -> DataFrame:
    """``pair`` with the metres of ``sides``; of the others nothing is computed, not even what an overlap writes first."""
    actual = stress_len_by_trip(trips, ways, **options) if "actual" in sides else _typed(trips)
    shortest = stress_len_shortest(routes, ways, **options) if "shortest" in sides else _measured(routes)
    return pair(actual, shortest)


def distinct_overlaps(overlaps: DataFrame) -> DataFrame:
    """Union of the bands without repeated rows; ``shape`` compares the regions."""
    return overlaps.select("trip_id", "osm_id", "hname", "stress_lev", "seg_area", "shape").distinct()


def street_trip_count(overlaps: DataFrame) -> DataFrame:
    """Per street: trips along it and their summed overlap.

    Two steps, street and trip first, so that a street with most of the trips is counted from partial
    results.
    """
    return (
        distinct_overlaps(overlaps).filter(F.col("seg_area") > OVERLAP_MIN_M2)
        .groupBy("osm_id")
        .agg(
            F.max("hname").alias("hname"),
            F.sum(F.coalesce(F.col("seg_area"), F.lit(0.0))).alias("sumarea_ovlp_trps"),
            F.max("stress_lev").alias("stress_lev"),
            F.count_distinct("trip_id").alias("count"),
        )
    )
