"""Every analysis as ``name -> (spark, sf_dir) -> DataFrame`` on the synthetic network.

Each entry builds its inputs from whole tables, runs a plan, and rounds doubles so that another engine
can be compared. Nothing here is needed to use the plans on real data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streetflow.functions import geometry as G
from streetflow.functions import projection as P
from streetflow.operators import overlap as O
from streetflow.operators.storage import run_dir
from streetflow.plans import (
    area_reports,
    classify,
    detour,
    direction,
    endpoints,
    routing,
    shares,
    stats,
    stress,
)
from streetflow.schema import BANDS, BUFFER_M, DIRECTION_SEGMENT, ROUTE_CSV
from streetflow.sources import csv, geojson, saved, synthetic, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DEGREE_DIGITS = 7


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column; ``special`` names columns with other digits."""
    return df.select(*[
        F.round(c, special.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _scaled(c: str, digits: int = 6) -> Column:
    """A double rounded by its binary value, as the SQL does: of decimals that end in 5, ``round`` goes by their text."""
    return F.round(F.col(c) * 10**digits) / 10**digits


def _ways(spark, d):
    return classify.with_cycleable(synthetic.ways(spark, d))


def _pairs(spark, d, *sides):
    """Actual and shortest paths with the metres by class of ``sides``."""
    routes = synthetic.routes(spark, d).withColumn("dist_ratio", F.col("dist_ratio").try_cast("double"))
    return stress.stress_len_pair(synthetic.trips(spark, d), routes, _ways(spark, d), sides)


def _segments(spark, d):
    return direction.segment_direction(synthetic.trips(spark, d), _ways(spark, d))


def _clean(spark, d):
    return detour.clean_routes(_route_text(spark, d))


def _route_text(spark, d):
    """Routing results the way they arrive: all columns text."""
    o, e = (P.to_lonlat(p["x"], p["y"]) for p in (G.start_point(F.col("geom")), G.end_point(F.col("geom"))))
    routes = synthetic.routes(spark, d).withColumn("_o", o).withColumn("_d", e).withColumns({
        c: F.round(F.col(f"_{c[-1]}.{'x' if c[1] == 'o' else 'y'}"), DEGREE_DIGITS).cast("string")
        for c in ("lon_o", "lat_o", "lon_d", "lat_d")})
    return tables.conform(routes, ROUTE_CSV).withColumn("band", F.element_at(
        F.array(*[F.lit(b) for b in BANDS]), (F.col("trip_id").cast("long") % 4 + 1).cast("int")))


# ---------------------------------------------------------------- endpoints and points

@query
def trip_endpoints(spark, d):
    out = endpoints.parse_endpoints(endpoints.trip_endpoints(synthetic.trips(spark, d)))
    return rounded(out.select(
        "trip_id", "band", "dist_calc", "od_line_dist", "matching_error", "propulsion_type",
        "lon_o", "lat_o", "lon_d", "lat_d"), lon_o=DEGREE_DIGITS, lat_o=DEGREE_DIGITS,
        lon_d=DEGREE_DIGITS, lat_d=DEGREE_DIGITS)


@query
def od_line_distance(spark, d):
    return rounded(endpoints.od_line_distance(synthetic.trips(spark, d)).select("trip_id", "band", "od_line_dist"), 4)


@query
def line_measures(spark, d):
    """Start, end, length and straight-line distance of each trip line."""
    g = F.col("geom")
    a, b = G.start_point(g), G.end_point(g)
    return rounded(synthetic.trips(spark, d).select(
        "trip_id", "band", a["x"].alias("sx"), a["y"].alias("sy"), b["x"].alias("ex"), b["y"].alias("ey"),
        G.line_length(g).alias("length"), G.distance(a, b).alias("straight")))


@query
def street_buffer_area(spark, d):
    """Pieces and area of each street's flat-cap buffer (collinear vertices add no bevel)."""
    pieces = G.buffer_pieces(F.col("geom"), BUFFER_M)
    return rounded(synthetic.ways(spark, d).select(
        "osm_id", F.size(pieces).cast("long").alias("pieces"),
        F.aggregate(pieces, F.lit(0.0), lambda acc, p: acc + G.ring_area(p)).alias("area")))


@query
def area_outline(spark, d):
    """Projection both ways: areas stored in degrees, measured in metres."""
    rings = P.rings_to_metric(F.col("rings"))
    corner = F.col("rings")[0][0]
    return rounded(synthetic.areas_lonlat(spark, d).select(
        "municipal", G.polygon_area(rings).alias("area"), corner["x"].alias("lon"), corner["y"].alias("lat")),
        3, lon=DEGREE_DIGITS, lat=DEGREE_DIGITS)


# ---------------------------------------------------------------- street classes

@query
def street_class_tags(spark, d):
    return classify.tag_rule(synthetic.ways(spark, d)).select("osm_id", "cycle")


@query
def street_class_tags_loose(spark, d):
    return classify.loose_tag_rule(synthetic.ways(spark, d)).select("osm_id", "cycle_1")


@query
def loose_network(spark, d):
    return classify.loose_network(synthetic.ways(spark, d)).select("osm_id", "stress_lev", "cycle_1")


@query
def street_class_roads(spark, d):
    return classify.class_rule(synthetic.ways(spark, d)).select("osm_id", "cycle")


@query
def cycleway_network(spark, d):
    return classify.cycleway_network(synthetic.ways(spark, d)).select("osm_id", "highway", "bicycle", "other_tags")


@query
def street_class_cyclable(spark, d):
    return classify.reset_cycleable(_ways(spark, d)).select("osm_id", "lts", "cycleable")


@query
def interstate_classes(spark, d):
    return classify.interstate_classes(synthetic.ways(spark, d))


@query
def lts_update_join(spark, d):
    return classify.copy_class(synthetic.update_target(spark, d), synthetic.update_source(spark, d))


# ---------------------------------------------------------------- overlap and stress

@query
def overlap_trip_street(spark, d):
    return rounded(stress.overlap_trip_street(synthetic.trips(spark, d), _ways(spark, d)).drop("shape"))


@query
def overlap_parts(spark, d):
    """The dissolved overlap dumped to disjoint parts: their summed area per trip and street."""
    parts = O.overlap_parts(synthetic.trips(spark, d), classify.ridden(_ways(spark, d)))
    return rounded(parts.groupBy("band", "trip_id", "osm_id").agg(F.sum(G.ring_area(F.col("part"))).alias("area")))


@query
def overlap_dissolve(spark, d):
    merged = stress.dissolve(stress.overlap_trip_street(synthetic.trips(spark, d), _ways(spark, d)))
    return rounded(merged.filter(F.col("area") > 0).drop("shape"))


@query
def overlap_regions(spark, d):
    """Connected parts of each overlap: how many, their area and the length of all their rings."""
    regions = O.overlap_regions(synthetic.trips(spark, d), classify.ridden(_ways(spark, d)))
    ring_m = F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p["ring_m"])
    corners = F.aggregate("parts", F.lit(0).cast("long"), lambda acc, p: acc + F.aggregate(
        p["rings"], F.lit(0).cast("long"), lambda n, r: n + F.size(r)))
    return rounded(regions.select(
        "band", "trip_id", "osm_id", "hname", "stress_lev", "seg_area", F.size("parts").cast("long").alias("parts"),
        corners.alias("corners"), ring_m.alias("ring_m")))


@query
def dissolved_parts(spark, d):
    """One row per part of every distinct region of a trip and class, with its lowest corner."""
    out = stress.dissolved_parts(synthetic.trips(spark, d), _ways(spark, d))
    low = F.col("rings")[0][0]
    return rounded(out.select("band", "trip_id", "stress_lev", low["x"].alias("x"), low["y"].alias("y"), "area", "ring_m",
                              "sum_seg_area"))


@query
def stress_area_by_trip(spark, d):
    return rounded(stress.stress_area_by_trip(synthetic.trips(spark, d), _ways(spark, d)).select(
        "trip_id", "band", *stress.AREAS))


@query
def saved_stress_area(spark, d):
    """Trips and overlaps saved in buckets, one band refreshed, and the report from the saved tables."""
    trips, net = synthetic.trips(spark, d), _ways(spark, d)
    late = F.col("band") == BANDS[1]
    table = saved.save(stress.overlap_trip_street(trips.filter(~late), net), "overlap")
    saved.refresh(stress.overlap_trip_street(trips.filter(late), net), table)
    kept = saved.save(trips.select("trip_id", "band"), "trips")
    return rounded(stress.saved_stress_area(saved.saved(spark, kept), saved.saved(spark, table)).select(
        "trip_id", "band", *stress.AREAS))


@query
def stress_len_by_trip(spark, d):
    return rounded(stress.stress_len_by_trip(synthetic.trips(spark, d), _ways(spark, d)).drop("geom"))


@query
def stress_len_shortest(spark, d):
    return rounded(stress.stress_len_shortest(synthetic.routes(spark, d), _ways(spark, d)).drop("geom"))


@query
def stress_len_pair(spark, d):
    return rounded(_pairs(spark, d, "actual", "shortest").drop("geom"))


@query
def street_trip_count(spark, d):
    return rounded(stress.street_trip_count(
        stress.overlap_trip_street(synthetic.trips(spark, d), _ways(spark, d))))


# ---------------------------------------------------------------- direction

@query
def segment_direction(spark, d):
    g = F.col("geom")
    return rounded(_segments(spark, d).select(
        "band", "osm_id", "name", "highway", "lanes", "trip_id", "vehicle_type", "propulsion_type",
        g[0]["x"].alias("sx"), g[0]["y"].alias("sy"), g[1]["x"].alias("ex"), g[1]["y"].alias("ey"),
        "angle", "f1", "f2", "angle_mod", "angle_mod_1", "seg_len"))


@query
def segment_table(spark, d):
    """Segments inserted into a declared table and read back."""
    path = run_dir(spark, "segments")
    tables.insert_into(_segments(spark, d), path, DIRECTION_SEGMENT)
    return rounded(spark.read.schema(DIRECTION_SEGMENT).parquet(path).groupBy("band", "osm_id").agg(
        F.count("*").alias("n"), F.sum("seg_len").alias("m")))


@query
def contraflow_by_street(spark, d):
    return rounded(direction.by_count(direction.contraflow_by_street(_segments(spark, d)).drop("way_key")))


@query
def samedir_by_street(spark, d):
    return rounded(direction.by_count(direction.samedir_by_street(_segments(spark, d)).drop("way_key")))


@query
def samedir_by_street_strict(spark, d):
    return rounded(direction.samedir_by_street(_segments(spark, d), strict_len=True).drop("way_key"))


@query
def street_direction_totals(spark, d):
    return rounded(direction.street_totals(_segments(spark, d), _ways(spark, d)).drop("geom"))


@query
def contraflow_totals(spark, d):
    return rounded(direction.contraflow_totals(_segments(spark, d), _ways(spark, d)).drop("geom"))


@query
def saved_contraflow_totals(spark, d):
    """Segments saved in buckets once for two reports: the totals, and how many trips ride against a street."""
    segments = saved.saved(spark, saved.save(_segments(spark, d), "segments"))
    trips = direction.contraflow_trip_count(segments, _ways(spark, d))
    return rounded(direction.contraflow_totals(segments, _ways(spark, d)).drop("geom").withColumn("trips", trips.scalar()))


@query
def trips_with_contraflow(spark, d):
    return direction.trips_with_contraflow(_segments(spark, d), _ways(spark, d))


@query
def contraflow_trip_count(spark, d):
    return direction.contraflow_trip_count(_segments(spark, d), _ways(spark, d))


@query
def contraflow_metres(spark, d):
    return rounded(area_reports.contraflow_metres(
        _segments(spark, d), _ways(spark, d), synthetic.areas(spark, d), synthetic.STUDY_AREAS))


# ---------------------------------------------------------------- areas

@query
def network_length_by_class(spark, d):
    return rounded(area_reports.network_length_by_class(
        _ways(spark, d), synthetic.areas_lonlat(spark, d), synthetic.STUDY_AREAS))


@query
def area_trips(spark, d):
    return area_reports.area_trips(synthetic.trips(spark, d), synthetic.areas(spark, d), synthetic.STUDY_AREAS)


@query
def area_metres(spark, d):
    return rounded(area_reports.area_metres(area_trips(spark, d)))


@query
def area_contraflow_share(spark, d):
    return rounded(area_reports.area_contraflow_share(area_trips(spark, d), _segments(spark, d), _ways(spark, d)))


# ---------------------------------------------------------------- routes and detour

@query
def shortest_paths(spark, d):
    """Every trip's route: its length as searched and as measured along the line."""
    out = routing.model_routes(synthetic.trips(spark, d), synthetic.ways(spark, d))
    return rounded(out.select("trip_id", "band", "dist_calc", "f_distance", "dist_ratio", "route_status",
                              G.line_length(F.col("f_line")).alias("path_m")), 3)


@query
def routed_features(spark, d):
    """The router's own lines to one GeoJSON collection, loaded back into a metric table."""
    root = run_dir(spark, "routed")
    found = routing.model_routes(synthetic.trips(spark, d), synthetic.ways(spark, d)).filter("route_status = 'ok'")
    geojson.write_geojson(found.withColumn("geom", P.line_to_lonlat(F.col("f_line"))), f"{root}/features")
    table = geojson.load_projected(spark, f"{root}/features", f"{root}/table")
    return rounded(table.select("type", "trip_id", "dist_calc", "f_distance", "dist_ratio", "propulsion_type",
                                G.line_length(F.col("geom")).alias("length")), 3)


@query
def route_merge_clean(spark, d):
    """Text result files of all bands written, read back by glob, unioned by name and cleaned.

    Every band orders its columns differently, and the last one has no matching error.
    """
    root = run_dir(spark, "routes")
    text = _route_text(spark, d)
    names = [c for c in text.columns if c != "band"]
    for i, band in enumerate(BANDS):
        order = [c for c in names[i:] + names[:i] if band != BANDS[-1] or c != "matching_error"]
        csv.write_csv(text.filter(F.col("band") == band).select(*order), f"{root}/{band}/csv_files")
    clean = detour.clean_routes(csv.read_banded_csv(spark, root))
    # degrees have seven digits in the files, so every tenth of them is a tie
    return rounded(clean.withColumns({c: _scaled(c) for c in ("lon_o", "lat_o", "lon_d", "lat_d")}))


@query
def route_table_typed(spark, d):
    """Cleaned routes through CSV with an explicit schema, columns matched by header name."""
    path = run_dir(spark, "typed")
    csv.write_csv(_clean(spark, d).select("dist_calc", "trip_id", "f_distance"), path)
    schema = _clean(spark, d).select("trip_id", "dist_calc", "f_distance").schema
    return rounded(csv.read_csv(spark, path, schema))


@query
def nonloop_trips(spark, d):
    return rounded(detour.nonloop_trips(_clean(spark, d)).select("trip_id", "band", "dist_calc", "dist_ratio"))


@query
def below_network_length(spark, d):
    return rounded(detour.below_network_length(_clean(spark, d)).select("trip_id", "dist_calc", "dist_ratio"))


@query
def ratio_near_one(spark, d):
    return detour.ratio_near_one(_clean(spark, d))


@query
def detour_histogram(spark, d):
    return rounded(detour.detour_histogram(_clean(spark, d)))


@query
def detour_bins_rel(spark, d):
    return rounded(detour.detour_bins_rel(_clean(spark, d)))


@query
def detour_bins_count(spark, d):
    return detour.detour_bins_count(_clean(spark, d))


@query
def detour_quantiles(spark, d):
    return rounded(detour.detour_quantiles(_clean(spark, d)))


# ---------------------------------------------------------------- shares

@query
def low_stress_curve(spark, d):
    return rounded(shares.low_stress_curve(_pairs(spark, d, "actual")).drop("bin"))


@query
def stress_shares(spark, d):
    return rounded(shares.study_pairs(_pairs(spark, d, "actual"), ["dist_calc", *shares.LENGTHS]).select(
        "trip_id", "band", "len_1_p", "len_2_p", "len_1_11_p", "len_1_2_11_p", "len_3_p", "len_4_p"))


@query
def stress_totals(spark, d):
    return rounded(shares.stress_totals(_pairs(spark, d, "actual", "shortest")), 3)


@query
def trips_by_daytype(spark, d):
    return shares.trips_by_daytype(_pairs(spark, d))


@query
def stress_share_by_daytype(spark, d):
    return rounded(shares.stress_share_by_daytype(_pairs(spark, d, "actual")))


@query
def stress_share_table(spark, d):
    return rounded(shares.stress_share_table(_pairs(spark, d, "actual")))


@query
def trip_length_stats(spark, d):
    return rounded(stats.trip_length_stats(synthetic.trips(spark, d)))


@query
def trip_length_by_vehicle(spark, d):
    """Through a named view of all bands."""
    tables.create_view(synthetic.trips(spark, d), "all_band_trips")
    return rounded(stats.trip_length_by(spark.table("all_band_trips"), "vehicle"))


# ---------------------------------------------------------------- files

def _export(spark, d):
    # a trip listed in two bands has one pair of ends
    ends = synthetic.trips(spark, d).select("trip_id", "lon_o", "lat_o", "lon_d", "lat_d").distinct()
    routes = _clean(spark, d).select("trip_id", "band", "dist_calc", "f_distance", "safe_ratio", "propulsion_type")
    lines = synthetic.routes(spark, d).select("trip_id", P.line_to_lonlat(F.col("geom")).alias("geom"))
    return routes.withColumnRenamed("safe_ratio", "dist_ratio").join(ends, "trip_id").join(lines, "trip_id")


@query
def geojson_export(spark, d):
    """Routes to one collection, loaded back into a metric table."""
    root = run_dir(spark, "geojson")
    geojson.write_geojson(_export(spark, d), f"{root}/features")
    table = geojson.load_projected(spark, f"{root}/features", f"{root}/table")
    return rounded(table.select(
        "type", "trip_id", "dist_calc", "f_distance", "dist_ratio", "propulsion_type",
        "lon_o", "lat_o", "lon_d", "lat_d", G.line_length(F.col("geom")).alias("length")), 3)


@query
def geojson_merge(spark, d):
    """Many small collections per band merged into one per band, all bands in one pass."""
    root = run_dir(spark, "merge")
    geojson.write_geojson(_export(spark, d).withColumn(
        "batch", F.pmod(F.xxhash64("trip_id"), F.lit(5))), f"{root}/small", by=["band", "batch"])
    geojson.merge_geojson(spark, f"{root}/small", f"{root}/merged", by=["band"])
    out = geojson.read_geojson_lines(spark, f"{root}/merged").withColumn("metric", P.line_to_metric(F.col("geom")))
    return rounded(out.groupBy("band", "propulsion_type").agg(
        F.count("*").alias("features"), F.sum("dist_calc").alias("dist_calc"),
        F.sum(F.size("geom")).alias("vertices"), F.sum(G.line_length(F.col("metric"))).alias("length")), 3)


@query
def banded_trip_table(spark, d):
    """Trips written by band, copied, and scanned for one band: only its files are read."""
    root = run_dir(spark, "trips")
    tables.write_trips(synthetic.trips(spark, d), f"{root}/trips")
    copied = tables.copy_table(spark, f"{root}/trips", f"{root}/copy", ["band"])
    return rounded(direction.good_bicycle_trips(copied.filter(F.col("band") == BANDS[2])).groupBy(
        "propulsion_type").agg(F.count("*").alias("trips"), F.sum("dist_calc").alias("metres")))
