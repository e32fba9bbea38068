"""Riding with and against the direction of one-way streets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetflow.functions import geometry as G
from streetflow.operators.clip import clip_to_buffers
from streetflow.plans.classify import is_simple_one_way, one_way
from streetflow.schema import BANDS, MATCHING_ERROR_MAX, SEGMENT_MIN_M

TRIP_COLUMNS = ["band", "trip_id", "vehicle_type", "propulsion_type"]
WAY_COLUMNS = ["osm_id", "name", "highway", "lanes"]


def good_bicycle_trips(trips: DataFrame) -> DataFrame:
    return trips.filter((F.col("vehicle_type") == "bicycle") & (F.col("matching_error") < MATCHING_ERROR_MAX))


def segment_direction(trips: DataFrame, ways: DataFrame, **options) -> DataFrame:
    """Every two-vertex piece of a good bicycle trip inside a one-way street's buffer, with its angle.

    ``angle`` compares the piece with the line between its ends' nearest street points. Those already
    follow the trip, so the drawn direction of the street comes in through the fractions f1 and f2.
    """
    pieces = clip_to_buffers(good_bicycle_trips(trips), one_way(ways), TRIP_COLUMNS, WAY_COLUMNS, **options)
    angle = F.rint(F.degrees(G.angle_between(F.col("at0"), F.col("at1"), F.col("s0"), F.col("s1"))))
    # Bound values: a filter on the final angle is pushed below these columns and would repeat them.
    turned = G.let(F.col("angle"), lambda v: F.when(F.col("f1") > F.col("f2"), v + 180).otherwise(v))
    folded = G.let(F.col("angle_mod"), lambda v: F.when(v > 360, v - 360).otherwise(v))
    return (
        pieces.withColumn("angle", angle)
        .withColumn("f1", F.col("at0.fraction")).withColumn("f2", F.col("at1.fraction"))
        .withColumn("angle_mod", turned)
        .withColumn("angle_mod_1", folded)
        .select(
            "band", "osm_id", "way_key", "name", "highway", "lanes", "trip_id", "vehicle_type", "propulsion_type",
            F.array("s0", "s1").alias("geom"), "angle", "f1", "f2", "angle_mod", "angle_mod_1",
            G.distance(F.col("s0"), F.col("s1")).alias("seg_len"))
    )


def is_contraflow() -> Column:
    return F.col("angle_mod_1").between(170, 190) & (F.col("seg_len") > SEGMENT_MIN_M)


def is_same_direction(strict_len: bool = False) -> Column:
    """As published, the length limit binds to the first range only; ``strict_len`` applies it to both."""
    forward, wrapped = F.col("angle_mod_1").between(0, 10), F.col("angle_mod_1").between(350, 360)
    long_enough = F.col("seg_len") > SEGMENT_MIN_M
    return long_enough & (forward | wrapped) if strict_len else (long_enough & forward) | wrapped


def _by_street(segments: DataFrame, match: Column) -> DataFrame:
    """Distinct trips and metres per street and band; first per trip, so no street is one task's work."""
    per_trip = segments.filter(match).groupBy("band", "osm_id", "way_key", "trip_id").agg(
        F.min("name").alias("name"), F.sum("seg_len").alias("m"))
    return (
        per_trip.groupBy("band", "osm_id", "way_key")
        .agg(F.min("name").alias("name"), F.count("trip_id").alias("cnt"), F.sum("m").alias("tot_m"))
        .filter(F.col("cnt") > 0)
    )


def contraflow_by_street(segments: DataFrame) -> DataFrame:
    return _by_street(segments, is_contraflow())


def samedir_by_street(segments: DataFrame, strict_len: bool = False) -> DataFrame:
    return _by_street(segments, is_same_direction(strict_len))


def by_count(streets: DataFrame) -> DataFrame:
    """Report order: least ridden first, ties by street."""
    return streets.orderBy("cnt", "band", "osm_id")


def street_totals(segments: DataFrame, ways: DataFrame) -> DataFrame:
    """Contraflow and same-direction metres and trips per one-way street over all bands.

    One conditional aggregate replaces a join per band and direction; saved segments are summed up per trip where they
    lie. Columns per band stay NULL where
    a band has none; the totals count them as zero.
    """
    trip = [c for c in ("band", "trip_id", "trip_key") if c in segments.columns]
    flags = segments.select(
        "osm_id", *trip, "seg_len",
        is_contraflow().alias("contra"), is_same_direction().alias("same"))
    per_trip = flags.groupBy("osm_id", *trip).agg(
        F.sum(F.when(F.col("contra"), F.col("seg_len"))).alias("contra_m"),
        F.sum(F.when(F.col("same"), F.col("seg_len"))).alias("same_m"))
    cells = []
    for band in BANDS:
        here = F.col("band") == band
        for way in ("contra", "same"):
            metres = F.when(here, F.col(f"{way}_m"))
            counted = F.when(here & F.col(f"{way}_m").isNotNull(), F.col("trip_id"))
            cells += [F.sum(metres).alias(f"{way}_tot_m_{band}"), F.count(counted).alias(f"{way}_cnt_{band}")]
    totals = per_trip.groupBy("osm_id").agg(*cells)
    streets = ways.join(one_way(ways).select("osm_id").distinct(), "osm_id", "left_semi")
    joined = streets.select("osm_id", "name", "highway", "geom").join(totals, "osm_id", "left")

    def over_bands(column: str, zero) -> Column:
        first, *rest = [F.coalesce(F.col(f"{column}_{b}"), F.lit(zero)) for b in BANDS]
        return sum(rest, first)

    return joined.select(
        "osm_id", "name", "highway", "geom",
        *[f"{way}_tot_m_{b}" for b in BANDS for way in ("contra", "same")],
        over_bands("contra_tot_m", 0.0).alias("tot_m_contra"), over_bands("same_tot_m", 0.0).alias("tot_m_same"),
        over_bands("contra_cnt", 0).cast("long").alias("tot_cnt_contra"),
        over_bands("same_cnt", 0).cast("long").alias("tot_cnt_same"))


def contraflow_totals(segments: DataFrame, ways: DataFrame) -> DataFrame:
    """Totals of the simple one-way streets."""
    simple = ways.filter(is_simple_one_way()).select("osm_id", F.col("highway").alias("simple_highway"))
    return street_totals(segments, ways).join(simple, "osm_id").select(
        F.col("osm_id").alias("osmid"), "geom", "name", "tot_m_contra", "tot_cnt_contra",
        "tot_m_same", "tot_cnt_same", F.col("simple_highway").alias("highway"))


def trips_with_contraflow(segments: DataFrame, ways: DataFrame) -> DataFrame:
    """Trips with at least one wrong-way piece on a simple one-way street."""
    simple = ways.filter(is_simple_one_way()).select("osm_id")
    return segments.filter(is_contraflow()).join(simple, "osm_id", "left_semi").select("trip_id").distinct()


def contraflow_trip_count(segments: DataFrame, ways: DataFrame) -> DataFrame:
    return trips_with_contraflow(segments, ways).agg(F.count("*").alias("trips"))
