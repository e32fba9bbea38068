"""Trips, streets, areas and routes derived from the star-schema tables.

Keys alone decide every value, lines are axis-aligned with whole-metre coordinates, and street lines
carry a vertex at each crossing. Buffers are then rectangles and each overlap, clip, angle and length
has a closed form that plain SQL can check, while multi-vertex streets still exercise dissolving.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetflow.functions import projection as P
from streetflow.schema import BANDS
from streetflow.sources.tables import read_table, spread

# Lower-left corner of the synthetic network in EPSG:26986.
BASE_X, BASE_Y = 230000, 890000
SPAN, GAP, LINES = 160, 100, 40


def extent(spark: SparkSession, sf_dir: str) -> int:
    """Length of the street lines; needs only the row count in the file footers."""
    return SPAN * (read_table(spark, sf_dir, "part").count() // (2 * LINES))


def _line(alongs: str) -> str:
    """SQL of the line through ``alongs`` at lateral position ``off``, in direction ``orient``."""
    return (f"transform({alongs}, v -> struct("
            f"CAST(IF(orient = 0, v, off) + {BASE_X} AS DOUBLE) AS x, "
            f"CAST(IF(orient = 0, off, v) + {BASE_Y} AS DOUBLE) AS y))")


OFF = f"{GAP} * (k div 2 % {LINES})"
BAND_LIST = ", ".join(f"'{b}'" for b in BANDS)


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = spread(read_table(spark, sf_dir, "part")).selectExpr(
        "p_partkey AS k", "p_partkey % 2 AS orient", f"{SPAN} * (p_partkey div {2 * LINES}) AS a0",
    ).selectExpr("*", f"{OFF} AS off", f"a0 + {SPAN} AS a1", f"{GAP} * (a0 div {GAP} + 1) AS m",
                 "CASE k % 7 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '3' WHEN 4 THEN '11' "
                 "WHEN 5 THEN NULL ELSE '4' END AS lts")
    return keyed.selectExpr(
        "CAST(k AS STRING) AS osm_id",
        "CASE WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN 'Round Circle ' || k ELSE 'Street ' || k END AS name",
        """CASE k % 12 WHEN 0 THEN 'motorway' WHEN 1 THEN 'motorway_link' WHEN 2 THEN 'trunk' WHEN 3 THEN 'service'
           WHEN 4 THEN 'cycleway' WHEN 5 THEN 'footway' WHEN 6 THEN NULL WHEN 7 THEN 'unclassified'
           WHEN 8 THEN 'pedestrian' ELSE 'residential' END AS highway""",
        "CASE k % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS oneway",
        "CASE WHEN k % 15 = 0 THEN 'yes' END AS divided_oneway",
        "lts", "CASE WHEN k % 24 = 0 THEN 'prohibited' ELSE lts END AS stress_lev",
        "CAST(k % 4 + 1 AS STRING) AS lanes",
        "CASE WHEN k % 29 = 0 THEN 'no' WHEN k % 4 = 0 THEN 'yes' END AS bicycle",
        """CASE WHEN k % 5 = 0 THEN NULL WHEN k % 17 = 0 THEN '"power"=>"line"'
           WHEN k % 19 = 0 THEN '"railway"=>"rail"' WHEN k % 23 = 0 THEN '"bicycle"=>"yes"'
           WHEN k % 29 = 0 THEN '"bicycle"=>"no"' WHEN k % 31 = 0 THEN '"cycleway:both"=>"no"'
           WHEN k % 37 = 0 THEN '"boundary"=>"administrative"' WHEN k % 41 = 0 THEN '"note"=>"Interstate ramp"'
           WHEN k % 43 = 0 THEN '"barrier"=>"fence"' ELSE '"surface"=>"asphalt"' END AS other_tags""",
        _line(f"array_distinct(filter(array(a0, m, m + {GAP}, a1), v -> v <= a1))") + " AS geom")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What trips and routes share: keys, position and length."""
    return spread(read_table(spark, sf_dir, "orders")).selectExpr(
        "o_orderkey AS k", "CAST(o_orderkey AS STRING) AS trip_id", "o_orderkey % 2 AS orient",
        "60 + o_orderkey % 900 AS length", f"37 * o_orderkey % {extent(spark, sf_dir)} AS s",
        "IF(o_orderpriority = '5-LOW', 'scooter', 'bicycle') AS vehicle_type",
        "IF(o_orderstatus = 'P', 'human', 'electric') AS propulsion_type",
        "round(o_totalprice) % 100 AS matching_error", "o_orderdate",
    ).selectExpr("*", "CAST(length AS DOUBLE) AS dist_calc",
                 "CAST(IF(k % 10 = 0, length div 5, length) AS DOUBLE) AS od_line_dist")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order; every fiftieth trip appears again under the next band.

    Every third line has a middle vertex and every seventh runs backwards.
    """
    copies = "IF(k % 50 = 0, array(k, k + 1), array(k))"
    placed = _orders(spark, sf_dir).selectExpr(
        "*", f"{OFF} + k % 6 AS off",
        "IF(k % 3 = 0, array(s, s + length div 2, s + length), array(s, s + length)) AS forward",
    ).selectExpr("*", _line("IF(k % 7 = 0, reverse(forward), forward)") + " AS geom")
    start, end = placed.geom[0], F.element_at(placed.geom, -1)
    ends = placed.withColumn("o", P.to_lonlat(start["x"], start["y"])).withColumn(
        "d", P.to_lonlat(end["x"], end["y"]))
    # The order dates run 1995-2001; the study's year labels are dealt out by year parity.
    return ends.selectExpr("*", f"explode({copies}) AS band_no").selectExpr(
        "trip_id", f"element_at(array({BAND_LIST}), CAST(band_no % 4 + 1 AS INT)) AS band",
        "vehicle_type", "propulsion_type",
        "CASE WHEN k % 211 <> 0 THEN CAST(o_orderdate AS TIMESTAMP_NTZ) + make_dt_interval(0, CAST(k % 24 AS INT)) END "
        "AS start_time",
        "'q' || quarter(o_orderdate) || '_' || (2018 + year(o_orderdate) % 2) AS quart_year",
        "dist_calc", "od_line_dist", "matching_error",
        "o.x AS lon_o", "o.y AS lat_o", "d.x AS lon_d", "d.y AS lat_d", "geom")


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modelled paths: the street's own centre line, shortened to length * 100 / c metres."""
    return _orders(spark, sf_dir).selectExpr("*", f"{OFF} AS off", "95 + k % 400 AS c").selectExpr(
        "trip_id", f"element_at(array({BAND_LIST}), CAST(k % 4 + 1 AS INT)) AS band",
        "dist_calc", "od_line_dist", "matching_error", "propulsion_type",
        "CAST(length * 100 / c AS DOUBLE) AS f_distance",
        "CASE WHEN k % 97 = 0 THEN 'inf' WHEN k % 89 = 0 THEN '-999999' "
        "ELSE (c div 100) || '.' || lpad(CAST(c % 100 AS STRING), 2, '0') END AS dist_ratio",
        _line("array(s, s + length * 100 div c)") + " AS geom")


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A five-by-five mosaic; borders at odd metres so that no street lies on one."""
    k = F.col("n_nationkey")
    w = extent(spark, sf_dir) // 5
    x0, y0 = (k % 5) * w + 37 + BASE_X, F.expr("n_nationkey div 5") * 800 + 53 + BASE_Y
    x1, y1 = x0 + w, y0 + 800

    def pt(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    ring = F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1), pt(x0, y0))
    return read_table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("municipal"), F.array(ring).alias("rings"))


def areas_lonlat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same areas in EPSG:4326, as the copy that has to be transformed on read."""
    return areas(spark, sf_dir).withColumn("rings", P.rings_to_lonlat(F.col("rings")))


STUDY_AREAS = [f"NATION_{i}" for i in range(0, 25, 3)]


def update_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("osm_id")).distinct()


def update_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ways(spark, sf_dir).filter(F.col("osm_id").cast("long") % 3 != 1).select("osm_id", "lts")
