"""Operators on small fixtures against brute force."""

import heapq
import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from streetflow.functions import geometry as G
from streetflow.functions import projection as P
from streetflow.functions import text as T
from streetflow.operators import areas as A
from streetflow.operators import bins, graph, storage
from streetflow.operators import overlap as O
from streetflow.operators.quantiles import exact_quantiles
from streetflow.plans import classify, direction, endpoints, routing, shares, stress
from streetflow.sources import csv, geojson, synthetic

SF = "/root/testdata/sf0.001"
LINE = "array<struct<x:double,y:double>>"
WAY = ("osm_id string, name string, highway string, oneway string, divided_oneway string, lts string, lanes string, "
       f"other_tags string, cycleable string, geom {LINE}")
TRIP = ("trip_id string, band string, vehicle_type string, propulsion_type string, matching_error double, "
        f"dist_calc double, start_time timestamp_ntz, geom {LINE}")


def way(i, line, lts="1", oneway="yes"):
    return (str(i), f"Street {i}", "residential", oneway, None, lts, "1", None, None, [tuple(map(float, p)) for p in line])


def trip(i, line, band="00_140", dist=100.0):
    return (str(i), band, "bicycle", "human", 1.0, dist, None, [tuple(map(float, p)) for p in line])


def turned(line, angle):
    c, s = math.cos(angle), math.sin(angle)
    return [(c * x - s * y, s * x + c * y) for x, y in line]


def test_salted_join_equals_broadcast_join(spark):
    trips, ways = synthetic.trips(spark, SF), classify.ridden(classify.with_cycleable(synthetic.ways(spark, SF)))
    key = ["band", "trip_id", "osm_id", "seg_area", "stress_lev", "shape"]
    a = O.overlap(trips, ways).select(*key).cache()
    b = O.overlap(trips, ways, max_broadcast=0, share=64).select(*key).cache()
    assert a.count() > 1000 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_same_street_twice_counts_its_region_once(spark):
    line = turned([(1000, 50), (1300, 50)], 0.2)
    ways = spark.createDataFrame([way(1, line), way(2, line), way(3, turned([(1000, 50), (1150, 50), (1300, 50)], 0.2))], WAY)
    trips = spark.createDataFrame([trip(1, line, dist=300.0)], TRIP)
    row = stress.stress_len_by_trip(trips, ways).first()
    assert row["area_1"] == pytest.approx(1200, abs=1e-4)
    assert row["len_1"] == pytest.approx(300, abs=1e-4)


def test_bevel_only_touch_is_found(spark):
    # The trip passes the outer corner inside the bevel's reach but clear of both rectangles' ends.
    ways = spark.createDataFrame([way(1, [(0, 0), (100, 0), (170, 70)])], WAY)
    near = spark.createDataFrame([trip(1, [(99, -3.9), (101.2, -3.9)]), trip(2, [(60, -4.5), (90, -4.5)])], TRIP)
    assert [r["trip_id"] for r in O.overlap(near, ways).collect()] == ["1"]


@pytest.mark.parametrize("angle", [0.0, 0.6, 2.5, 4.4])
def test_direction_of_rotated_rides(spark, angle):
    street = turned([(0, 0), (60, 0), (120, 0)], angle)
    ride = turned([(-10, 1), (50, 1), (130, 1)], angle)
    trips = spark.createDataFrame([trip(1, ride), trip(2, ride[::-1]), trip(3, turned([(60, -40), (60, 40)], angle))], TRIP)
    out = direction.segment_direction(trips, spark.createDataFrame([way(9, street)], WAY)).collect()
    by = {i: [r for r in out if r["trip_id"] == str(i)] for i in (1, 2, 3)}
    assert all(r["angle_mod_1"] in (0.0, 360.0) for r in by[1]) and all(r["angle_mod_1"] == 180.0 for r in by[2])
    for i in (1, 2):
        assert sum(r["seg_len"] for r in by[i]) == pytest.approx(120, abs=1e-6)
    assert sum(r["seg_len"] for r in by[3]) == pytest.approx(4, abs=1e-6)


def test_clip_covers_a_corner_once(spark):
    street = [(0, 0), (100, 0), (100, 100)]
    trips = spark.createDataFrame([trip(1, street)], TRIP)
    out = direction.segment_direction(trips, spark.createDataFrame([way(9, street)], WAY)).collect()
    assert sum(r["seg_len"] for r in out) == pytest.approx(200, abs=1e-6)
    assert {r["angle_mod_1"] for r in out if r["seg_len"] > 10} == {0.0}


def _in(p, rings):
    odd = False
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:]):
            if (y0 > p[1]) != (y1 > p[1]) and p[0] < x0 + (p[1] - y0) * (x1 - x0) / (y1 - y0):
                odd = not odd
    return odd


def test_lines_and_concave_areas_with_holes(spark):
    outer = [(0, 0), (2100, 130), (2300, 1900), (1100, 700), (150, 1850), (0, 0)]
    hole = [(700, 250), (1300, 300), (1000, 500), (700, 250)]
    rings = [[tuple(map(float, p)) for p in r] for r in (outer, hole)]
    area = spark.createDataFrame([("a", rings)], f"municipal string, rings array<{LINE}>")
    rnd = random.Random(3)
    lines = []
    for i in range(300):
        x, y, a, n = rnd.uniform(-300, 2600), rnd.uniform(-300, 2200), rnd.uniform(0, 7), rnd.choice([40, 900])
        lines.append((i, [(x, y), (x + n * math.cos(a) / 2, y + n * math.sin(a) / 2), (x + n * math.cos(a), y + n * math.sin(a))]))
    df = spark.createDataFrame(lines, f"id int, geom {LINE}").repartition(4)
    touching = {r["id"] for r in A.lines_touching(df, "geom", ["id"], area).select("id").distinct().collect()}
    within = {r["id"] for r in A.lines_within(df, "geom", area).collect()}
    assert within == {r["id"] for r in df.join(area.select(G.ring_edges(F.col("rings")).alias("edges"))).filter(
        G.line_within(F.col("geom"), F.col("edges"))).collect()}
    for size, most in ((90.0, 0), (700.0, 0), (5000.0, 1 << 26)):  # other cells, and cells joined by a shuffle
        assert touching == {r["id"] for r in A.lines_touching(df, "geom", ["id"], area, size=size, max_broadcast=most).select("id").distinct().collect()}
        assert within == {r["id"] for r in A.lines_within(df, "geom", area, size=size, max_broadcast=most).collect()}
    for i, (p, _, q) in lines:
        hits = [_in((p[0] + (q[0] - p[0]) * t, p[1] + (q[1] - p[1]) * t), rings) for t in np.linspace(0, 1, 4001)]
        assert (any(hits), all(hits)) == (i in touching, i in within), (i, sum(hits))


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    data = {"a": np.round(rng.lognormal(5, 2, 5000), 1), "b": rng.normal(0, 3, 777), "c": np.array([4.0])}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("d", None), (None, 1.0), (None, 3.0)]
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    out = {r["k"]: r for r in exact_quantiles(
        spark.createDataFrame(rows, "k string, v double"), ["k"], "v", probs, ["p0", "p1", "p2", "p3", "p4"],
        mean="m", count="n").collect()}
    assert set(out) == {"a", "b", "c", None}
    for k, vs in {**data, None: np.array([1.0, 3.0])}.items():
        got = [out[k][f"p{i}"] for i in range(5)]
        np.testing.assert_allclose(got, np.quantile(vs, probs), rtol=1e-12)
        assert out[k]["n"] == len(vs) and out[k]["m"] == pytest.approx(vs.mean())


def test_bins_agree_with_their_edges(spark):
    values = [i / 100 for i in range(90, 520)] + [1.005, 0.98, 1.0000001, 4.99]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for r in df.select("v", bins.right_closed(F.col("v"), 100).alias("r"), bins.left_closed(F.col("v"), 100).alias("l")).collect():
        assert r["r"] / 100 < r["v"] <= (r["r"] + 1) / 100
        assert r["l"] / 100 <= r["v"] < (r["l"] + 1) / 100


def test_survival_is_monotone_and_keeps_nulls_in_the_denominator(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.7,), (None,)], "v double")
    got = [r["c"] for r in bins.survival(df, {"c": F.col("v")}).orderBy("bin").collect()]
    assert len(got) == 1001 and got[0] == 0.8 and got[500] == 0.6 and got[501] == got[1000] == 0.4
    assert all(a >= b for a, b in zip(got, got[1:]))


def test_projection_known_points_and_round_trip(spark):
    df = spark.createDataFrame([(-71.5, 41.0), (-71.0589, 42.3601)], "lon double, lat double")
    rows = df.withColumn("m", P.to_metric(F.col("lon"), F.col("lat"))).withColumn(
        "b", P.to_lonlat(F.col("m.x"), F.col("m.y"))).collect()
    assert (rows[0].m.x, rows[0].m.y) == pytest.approx((200000, 750000), abs=1e-6)
    assert (rows[1].m.x, rows[1].m.y) == pytest.approx((236337.394, 901160.640), abs=2e-3)
    for r in rows:
        assert (r.b.x, r.b.y) == pytest.approx((r.lon, r.lat), abs=1e-8)


def test_wkt_round_trip_and_bad_text(spark):
    df = spark.createDataFrame([("POINT(-71.25 42.5)",), ("POINT EMPTY",), (None,)], "t string")
    got = [r["p"] for r in df.select(T.parse_point_wkt(F.col("t")).alias("p")).collect()]
    assert (got[0].x, got[0].y) == (-71.25, 42.5) and got[1] is None and got[2] is None
    back = df.limit(1).select(T.point_wkt(T.parse_point_wkt(F.col("t"))).alias("t")).first()
    assert back["t"] == "POINT(-71.25 42.5)"


def test_endpoint_text_matches_the_trip(spark):
    trips = synthetic.trips(spark, SF)
    row = endpoints.trip_endpoints(trips).first()
    assert row["matched_start"].startswith("POINT(-71.")


def test_sentinels_become_null(spark):
    df = spark.createDataFrame([("inf",), ("-999999",), ("1.5",), ("x",), ("NaN",)], "t string")
    assert [r[0] for r in df.select(T.safe_ratio(F.col("t"))).collect()] == [None, None, 1.5, None, None]


def test_day_type_without_time_is_nonpeak(spark):
    df = spark.sql("SELECT CAST(t AS TIMESTAMP_NTZ) AS t FROM VALUES ('2019-06-01 08:00:00'), ('2019-06-03 08:10:00'), "
                   "('2019-06-03 12:00:00'), (NULL) v(t)")
    assert [r[0] for r in df.select(shares.day_type(F.col("t"))).collect()] == [
        "weekend", "weekday_peak", "weekday_nonpeak", "weekday_nonpeak"]


def test_linear_referencing(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (10.0, 0.0), (10.0, 30.0)],)], f"g {LINE}")
    r = df.select(
        G.line_locate_point(F.col("g"), F.lit(12.0), F.lit(10.0)).alias("f"),
        G.closest_point(F.col("g"), F.lit(4.0), F.lit(-3.0)).alias("c"), G.line_length(F.col("g")).alias("n")).first()
    assert r["f"] == pytest.approx(0.5) and (r["c"].x, r["c"].y) == (4.0, 0.0) and r["n"] == 40.0


def test_geojson_parts_are_one_document(spark):
    rows = [(str(i), [(float(i), 2.0), (3.0, 4.0)], "ab"[i % 2]) for i in range(7)] + [("0", [(0.0, 2.0), (3.0, 4.0)], "a")]
    df = spark.createDataFrame(rows, f"trip_id string, geom {LINE}, band string").repartition(3)
    path = storage.run_dir(spark, "test")
    geojson.write_geojson(df, path, properties=["trip_id"], by=["band"])
    for band in "ab":
        lines = spark.read.text(f"{path}/band={band}").orderBy("part").collect()
        doc = json.loads("\n".join(r["value"] for r in lines))
        assert doc["type"] == "FeatureCollection"
        assert sorted(f["properties"]["trip_id"] for f in doc["features"]) == sorted(r[0] for r in rows if r[2] == band)
    for keys in (None, ["band"]):  # nothing to write: one collection without features, or none
        bare = storage.run_dir(spark, "test")
        geojson.write_geojson(df.filter("false"), bare, properties=["trip_id"], by=keys)
        text = spark.read.text(bare)
        lines = text.orderBy("part").collect() if "part" in text.columns else text.collect()
        assert [json.loads("".join(r["value"] for r in lines))] == [{"type": "FeatureCollection", "features": []}] if keys is None else lines == []
    back = geojson.read_geojson_lines(spark, path, StructType([StructField("trip_id", StringType())]))
    assert sorted((r["band"], r["trip_id"], r["geom"][0].x) for r in back.collect()) == sorted((r[2], r[0], r[1][0][0]) for r in rows)


def test_csv_columns_follow_each_files_header(spark):
    path = storage.run_dir(spark, "test")
    for name, values in (("00_140", "x trip_id"), ("141_320", "trip_id x y")):
        cols = values.split()
        spark.createDataFrame([tuple({"trip_id": "1", "x": "2", "y": "3"}[c] for c in cols)], cols).write.csv(
            f"{path}/{name}/csv_files", header=True)
    got = {r["band"]: (r["trip_id"], r["x"], r["y"]) for r in csv.read_banded_csv(spark, path, bands=["00_140", "141_320"]).collect()}
    assert got == {"00_140": ("1", "2", None), "141_320": ("1", "2", "3")}
    typed = csv.read_csv(spark, f"{path}/*/csv_files", StructType([StructField("y", LongType()), StructField("trip_id", StringType()),
                                                                  StructField("z", StringType())]))
    assert sorted(map(tuple, typed.collect()), key=str) == [(3, "1", None), (None, "1", None)]


def test_broadcast_is_bounded_by_bytes(spark):
    wide = spark.range(4).select("id", F.repeat(F.lit("x"), 10_000).alias("line"))
    assert storage.broadcast_if_small(wide, 50_000)[1] and not storage.broadcast_if_small(wide, 30_000)[1]
    assert storage.broadcast_if_small(wide.where("id < 0"), 0)[1]


def test_vertices_out_of_range_fail(spark):
    from streetflow.operators.graph import node_key

    df = spark.createDataFrame([(3e6, 0.0)], "x double, y double")
    with pytest.raises(Exception, match="2147"):
        df.select(node_key(F.col("x"), F.col("y"))).collect()


def test_share_queries_compute_no_unused_overlap(spark):
    from streetflow import catalogue

    def overlaps(name):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("ArrowEvalPython") + plan.count("MapInArrow") + plan.count("FlatMapGroupsInArrow")

    assert overlaps("trips_by_daytype") == 0
    assert overlaps("low_stress_curve") == overlaps("stress_share_by_daytype") == overlaps("stress_len_by_trip")


def test_share_queries_begin_no_unused_overlap(spark, monkeypatch):
    """An overlap writes its pieces and streets as soon as it is asked for, so it is asked for the sides in use only."""
    from streetflow import catalogue

    asked, made = [], stress.overlap_trip_street
    monkeypatch.setattr(stress, "overlap_trip_street", lambda *args, **kw: asked.append(1) or made(*args, **kw))
    for name, n in (("trips_by_daytype", 0), ("stress_share_table", 1), ("stress_shares", 1), ("stress_totals", 2)):
        asked.clear()
        catalogue.QUERIES[name](spark, SF)
        assert len(asked) == n, name


# ---------------------------------------------------------------- shortest paths

def _dijkstra(adj, start):
    best, heap = dict(start), [(d, n) for n, d in start.items()]
    heapq.heapify(heap)
    while heap:
        d, n = heapq.heappop(heap)
        if d > best.get(n, math.inf):
            continue
        for m, w in adj.get(n, []):
            if d + w < best.get(m, math.inf):
                best[m] = d + w
                heapq.heappush(heap, (d + w, m))
    return best


def test_shortest_paths_against_dijkstra(spark):
    rnd = random.Random(5)
    links = [((i, j), (i + 1, j)) for i in range(5) for j in range(6)] + [((i, j), (i, j + 1)) for i in range(6) for j in range(5)]
    links = [e for e in links if rnd.random() > 0.25] + [((20, 20), (21, 20))]

    def at(n):
        return (n[0] * 100.0 + (n[1] % 2) * 7, n[1] * 90.0)

    ways = spark.createDataFrame([way(k, [at(a), at(b)]) for k, (a, b) in enumerate(links)], WAY)
    adj = {}
    for a, b in links:
        w = math.dist(at(a), at(b))
        adj.setdefault(at(a), []).append((at(b), w))
        adj.setdefault(at(b), []).append((at(a), w))

    def snap(p):
        best = None
        for a, b in links:
            (x0, y0), (x1, y1) = at(a), at(b)
            t = max(0, min(1, ((p[0] - x0) * (x1 - x0) + (p[1] - y0) * (y1 - y0)) / math.dist(at(a), at(b)) ** 2))
            q = (x0 + t * (x1 - x0), y0 + t * (y1 - y0))
            if best is None or math.dist(p, q) < best[0]:
                best = (math.dist(p, q), q, at(a), at(b))
        return best[1:]

    od = [(rnd.uniform(-40, 560), rnd.uniform(-40, 500), rnd.uniform(-40, 560), rnd.uniform(-40, 500)) for _ in range(40)]
    od += [(2010.0, 1801.0, 2090.0, 1799.0), (10.0, 5.0, 2050.0, 1800.0), (10.0, 5.0, 10.0, 5.0)]
    got = graph.shortest_paths(spark.createDataFrame(od, "ox double, oy double, dx double, dy double"), ways).collect()
    assert len(got) == len(set(od))
    for r in got:
        (o, ou, ov), (d, du, dv) = snap((r.ox, r.oy)), snap((r.dx, r.dy))
        dist = _dijkstra(adj, {ou: math.dist(o, ou), ov: math.dist(o, ov)} if ou != ov else {ou: 0.0})
        want = min(dist.get(du, math.inf) + math.dist(du, d), dist.get(dv, math.inf) + math.dist(dv, d))
        if {ou, ov} == {du, dv}:
            want = min(want, math.dist(o, d))
        if want == math.inf:
            assert r.route_status == "unreachable" and r.f_distance is None
        else:
            assert r.f_distance == pytest.approx(want, abs=1e-2)
            line = [(p.x, p.y) for p in r.f_line]
            assert sum(math.dist(a, b) for a, b in zip(line, line[1:])) == pytest.approx(want, abs=2e-2)


def test_saved_tables_are_not_shuffled(spark):
    """Grouping by trip and joining two saved tables needs no exchange; a refreshed band replaces that band alone."""
    from streetflow.sources import saved

    rows = [("00_140", f"t{i}", f"s{i % 3}", "n", "1", 60.0 + i, i) for i in range(40)] + [("141_320", "t1", "s1", "n", "2", 70.0, 7)]
    schema = "band string, trip_id string, osm_id string, hname string, stress_lev string, seg_area double, shape long"
    table = saved.save(spark.createDataFrame(rows, schema), "test_overlap", buckets=4)
    trips = saved.save(spark.createDataFrame([(r[0], r[1]) for r in rows], "band string, trip_id string"), "test_trips", buckets=4)
    saved.refresh(spark.createDataFrame([("141_320", "t1", "s1", "n", "3", 90.0, 7), ("141_320", "t2", "s1", "n", "3", 55.0, 8)], schema), table)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        report = stress.saved_stress_area(saved.saved(spark, trips), saved.saved(spark, table))
        plan = report._jdf.queryExecution().executedPlan().toString()
        got = {(r["band"], r["trip_id"]): (r["area_1"], r["area_2"], r["area_3"]) for r in report.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert len(got) == 41 and got["141_320", "t1"] == (None, None, 90.0) and got["00_140", "t5"] == (65.0, None, None)
    assert saved.saved(spark, table).where("band = '141_320'").count() == 2


def test_chains_are_contracted(spark):
    """Degree-two nodes vanish but on rings; lengths, ends and lines stay."""
    lines = [[(0, 0), (10, 0)], [(20, 0), (10, 0)], [(20, 0), (30, 5), (40, 0)], [(0, 0), (0, 50)], [(0, 0), (-50, 0)],  # a chain of three, two stubs
             [(40, 0), (60, 0)], [(40, 0), (40, 30)], [(40, 30), (70, 30)], [(70, 30), (60, 0)], [(60, 0), (90, 0)],  # a ring with two exits
             [(500, 0), (510, 0)], [(510, 0), (505, 9)], [(505, 9), (500, 0)],  # a ring on its own
             [(700, 0), (710, 0), (710, 10), (700, 0)], [(700, 0), (690, 0)]]  # a loop with a stub
    ways = spark.createDataFrame([way(k, [tuple(map(float, p)) for p in line]) for k, line in enumerate(lines)], WAY)
    pieces = graph.edges(ways)
    rows = graph.contract(pieces, graph.components(pieces)).collect()
    ends = [tuple(sorted(((r.line[0].x, r.line[0].y), (r.line[-1].x, r.line[-1].y)))) for r in rows]
    assert sorted(ends) == sorted([
        ((0, 0), (40, 0)), ((0, 0), (0, 50)), ((-50, 0), (0, 0)), ((40, 0), (60, 0)), ((40, 0), (60, 0)), ((60, 0), (90, 0)),
        ((500, 0), (510, 0)), ((505, 9), (510, 0)), ((500, 0), (505, 9)), ((700, 0), (700, 0)), ((690, 0), (700, 0))])
    assert sum(r.len for r in rows) == pytest.approx(sum(math.dist(a, b) for line in lines for a, b in zip(line, line[1:])))
    for r in rows:
        assert r.len == pytest.approx(sum(math.dist((a.x, a.y), (b.x, b.y)) for a, b in zip(r.line, r.line[1:])))
    # along the bent chain, along the loop, and from the loop out
    od = [(12.0, 0.0, 38.0, 1.0), (702.0, 0.0, 702.0, 2.0), (710.0, 9.0, 690.0, 0.0)]
    got = {(r.ox, r.oy): r for r in graph.shortest_paths(spark.createDataFrame(od, "ox double, oy double, dx double, dy double"), ways).collect()}
    for r in got.values():
        assert r.f_distance == pytest.approx(sum(math.dist((a.x, a.y), (b.x, b.y)) for a, b in zip(r.f_line, r.f_line[1:])), abs=1e-6)
    assert (30.0, 5.0) in [(p.x, p.y) for p in got[12.0, 0.0].f_line]
    assert got[702.0, 0.0].f_distance == pytest.approx(2 + 8**0.5)  # back through the loop's own junction
    assert got[710.0, 9.0].f_distance == pytest.approx(1 + 200**0.5 + 10)


def test_routes_on_a_long_chain_cost_their_own_length(spark):
    """Chains keep a row per edge, routes meet the vertices they pass only, and lines are those along the streets."""
    n, rnd = 300, random.Random(3)
    lines = [[(40.0 * k + 20.0 * j, 5.0 * (j % 2)) for j in ((0, 1, 2) if rnd.random() < 0.5 else (2, 1, 0))] for k in range(n)]
    ways = spark.createDataFrame([way(k, line) for k, line in enumerate(lines)], WAY)
    pieces = graph.edges(ways)
    parts = graph.chained(pieces, graph.components(pieces))
    assert parts.count() == n and parts.agg(F.max(F.size("line"))).first()[0] == 3
    (chain,) = graph.chains(parts).collect()
    assert chain.len == pytest.approx(2 * n * math.hypot(20, 5))
    od = [tuple(rnd.uniform(0, 40.0 * n) if i % 2 == 0 else 2.5 for i in range(4)) for _ in range(20)] + [(0.0, 0.0, 40.0 * n, 0.0), (40.0 * n, 0.0, 0.0, 0.0)]
    for r in graph.shortest_paths(spark.createDataFrame(od, "ox double, oy double, dx double, dy double"), ways).collect():
        line = [(p.x, p.y) for p in r.f_line]
        between = [(20.0 * k, 5.0 * (k % 2)) for k in range(2 * n + 1) if min(line[0][0], line[-1][0]) < 20.0 * k < max(line[0][0], line[-1][0])]
        assert line[1:-1] == (between if r.ox <= r.dx else between[::-1])
        assert sum(math.dist(a, b) for a, b in zip(line, line[1:])) == pytest.approx(r.f_distance, abs=1e-4)


def test_ends_of_trips_are_converted_once(spark, monkeypatch):
    """What is searched is read back: a filter pushed below the projections repeats them within each other."""
    plans, found = [], routing.shortest_paths

    def seen(od, ways):
        plans.append(od._jdf.queryExecution().optimizedPlan().toString())
        return found(od, ways)

    monkeypatch.setattr(routing, "shortest_paths", seen)
    ways = spark.createDataFrame([way(1, [(230000.0, 890000.0), (230300.0, 890000.0)])], WAY)
    trips = synthetic.trips(spark, SF).limit(20).withColumn("lon_o", F.when(F.col("trip_id").cast("long") % 2 == 0, F.col("lon_o")))
    status = routing.model_routes(trips, ways).groupBy("lon_o").agg(F.first("route_status").alias("s")).collect()
    assert len(plans) == 1 and "ATAN" not in plans[0].upper() and "TAN(" not in plans[0].upper()
    assert {r.s for r in status if r.lon_o is None} == {"no_endpoints"} and "no_endpoints" not in {r.s for r in status if r.lon_o is not None}


def test_motorways_are_not_routed(spark):
    ways = synthetic.ways(spark, SF)
    assert routing.routable(ways).filter(F.col("highway").like("motorway%")).isEmpty()


def test_snapping_far_points_goes_down_the_pyramid(spark):
    """Far points find the same street as a comparison with all of them, and meet few cells however far off they are."""
    rnd = random.Random(8)
    lines = [[(x, y), (x + rnd.uniform(-300, 300), y + rnd.uniform(-300, 300))] for x, y in
             ((rnd.uniform(0, 20_000), rnd.uniform(0, 15_000)) for _ in range(500))]
    network = graph.edges(spark.createDataFrame([way(k, line) for k, line in enumerate(lines)], WAY))
    points = [(rnd.uniform(-1, 2) * 10 ** rnd.randint(2, 6), rnd.uniform(-1, 2) * 10 ** rnd.randint(2, 6)) for _ in range(300)] + [(-9e5, 7e5), (0.0, 0.0)]
    df = spark.createDataFrame(points, "px double, py double")

    def nearest(p):
        best = math.inf
        for (x0, y0), (x1, y1) in lines:
            t = max(0.0, min(1.0, ((p[0] - x0) * (x1 - x0) + (p[1] - y0) * (y1 - y0)) / math.dist((x0, y0), (x1, y1)) ** 2))
            best = min(best, math.dist(p, (x0 + t * (x1 - x0), y0 + t * (y1 - y0))))
        return best

    want = {p: nearest(p) for p in points}
    got = graph.nearest_edge(df, network).collect()
    assert len(got) == len(points)
    assert all(math.dist((r.px, r.py), (r.sx, r.sy)) == pytest.approx(want[r.px, r.py], abs=1e-4) for r in got)
    limited = graph.nearest_edge(df, network, limit=700.0).collect()
    assert len(limited) == len(points) and all((r.edge is None) == (want[r.px, r.py] > 700) for r in limited)
    cells = graph.grid.segment_cells(network, "line", ["edge"], "s", 0.0, 50.0).select("cx", "cy").distinct()
    met = graph._descend(df, cells, 50.0, None).groupBy("px", "py").count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
    assert met["n"] < 30 * len(points) and met["most"] < 300 < cells.count() / 10


def test_networks_may_be_wider_than_32_bits_of_millimetres(spark):
    """Streets beyond 2147 km, and places 2 ** 32 mm apart, are searched as they are near the origin."""
    around = [[(0, 0), (100, 0)], [(100, 0), (100, 50)], [(100, 0), (180, 0)], [(180, 0), (180, 50)], [(100, 50), (180, 50)]]
    places = [(0.0, 0.0), (2.0**32 / 1000, 0.0), (2.63e6, 3.29e6), (-9.1e6, 1.4e7)]
    ways = spark.createDataFrame([way(f"{k}_{i}", [(x + u, y + v) for u, v in line]) for k, (x, y) in enumerate(places)
                                  for i, line in enumerate(around)], WAY)
    od = [(x + 10.0, y + 1.0, x + 178.0, y + 49.0) for x, y in places] + [(10.0, 1.0, 2.63e6 + 10.0, 3.29e6 + 1.0)]
    rows = graph.shortest_paths(spark.createDataFrame(od, "ox double, oy double, dx double, dy double"), ways).collect()
    got = {(r.ox, r.oy, r.dx): r for r in rows}
    assert len(got) == 5 and got[10.0, 1.0, 2.63e6 + 10.0].route_status == "unreachable"
    for x, y in places:
        r = got[x + 10.0, y + 1.0, x + 178.0]
        assert r.f_distance == pytest.approx(90 + 50 + 78, abs=1e-5)
        assert sum(math.dist((a.x, a.y), (b.x, b.y)) for a, b in zip(r.f_line, r.f_line[1:])) == pytest.approx(218, abs=1e-5)


def test_features_of_routes_beyond_2147_km(spark, tmp_path):
    """Trips far out are routed, written as degrees and read back as metres."""
    x, y = 2_600_000.0, 3_200_000.0
    ways = spark.createDataFrame([way(1, [(x, y), (x + 300, y)]), way(2, [(x + 300, y), (x + 300, y + 200)])], WAY)
    ends = spark.createDataFrame([("1", x + 20, y, x + 300, y + 90), ("2", x + 290, y + 1, x + 5, y - 2)], "trip_id string, sx double, sy double, ex double, ey double")
    o, d = (P.to_lonlat(F.col(f"{k}x"), F.col(f"{k}y")) for k in "se")
    trips = ends.select("trip_id", F.lit("00_140").alias("band"), F.lit("human").alias("propulsion_type"), F.lit(400.0).alias("dist_calc"),
                        o["x"].alias("lon_o"), o["y"].alias("lat_o"), d["x"].alias("lon_d"), d["y"].alias("lat_d"))
    found = routing.model_routes(trips, ways).filter("route_status = 'ok'")
    geojson.write_geojson(found.withColumn("geom", P.line_to_lonlat(F.col("f_line"))), str(tmp_path / "features"))
    table = geojson.load_projected(spark, str(tmp_path / "features"), str(tmp_path / "table"))
    rows = table.select("trip_id", "f_distance", G.line_length(F.col("geom")).alias("length")).collect()
    assert {r["trip_id"]: r["f_distance"] for r in rows} == pytest.approx({"1": 370.0, "2": 285.0}, abs=2e-3)
    assert {r["trip_id"]: r["length"] for r in rows} == pytest.approx({"1": 370.0, "2": 285.0}, abs=2e-3)


def test_ends_far_off_the_network_are_not_snapped(spark):
    ways = spark.createDataFrame([way(1, [(0.0, 0.0), (300.0, 0.0)])], WAY)
    od = spark.createDataFrame([(10.0, 5.0, 200.0, 0.0), (10.0, 500.0, 200.0, 0.0)], "ox double, oy double, dx double, dy double")
    near = {r.oy: (r.route_status, r.f_distance) for r in graph.shortest_paths(od, ways, max_snap=60.0).collect()}
    assert near == {5.0: ("ok", pytest.approx(190.0)), 500.0: ("too_far", None)}
    free = {r.oy: r.route_status for r in graph.shortest_paths(od, ways).collect()}
    assert free == {5.0: "ok", 500.0: "ok"}


# ---------------------------------------------------------------- overlap as geometry

def test_parts_of_an_overlap_are_connected_across_cells(spark):
    # a trip round a block of streets with one id, over four cells; a street it crosses twice; the same street again
    block = turned([(1150, 50), (1350, 50), (1350, 250), (1150, 250), (1150, 51)], 0.1)
    across = turned([(1100, 150), (1400, 150)], 0.1)
    ways = spark.createDataFrame([way(1, block), way(2, across), way(3, across), way(4, across, lts="2")], WAY)
    trips = spark.createDataFrame([trip(1, block)], TRIP)
    found = {r["osm_id"]: r for r in O.overlap_regions(trips, ways).collect()}
    spread = {r["osm_id"]: r for r in O.overlap_regions(trips, ways, max_broadcast=0, share=64).collect()}
    assert {k: r["parts"] for k, r in found.items()} == {k: r["parts"] for k, r in spread.items()}
    (ring,) = found["1"]["parts"]
    assert len(ring["rings"]) == 2
    areas = {r["osm_id"]: r["seg_area"] for r in O.overlap(trips, ways).collect()}
    for i, r in found.items():
        assert sum(p["area"] for p in r["parts"]) == pytest.approx(areas[i], abs=1e-2)
    assert [len(found[i]["parts"]) for i in "234"] == [2, 2, 2]
    rows = stress.dissolved_parts(trips, ways).collect()
    assert sorted((r["stress_lev"], r["part"], round(r["sum_seg_area"], 2)) for r in rows) == [
        ("1", 0, 64.0), ("1", 0, round(areas["1"], 2)), ("1", 1, 64.0), ("2", 0, 32.0), ("2", 1, 32.0)]


def test_regions_of_equal_area_and_centre_stay_apart(spark):
    # crossings at -a and +a, or at -b and +b: equal area and first moments, other outlines
    line = [(1000, 50), (1180, 50)]

    def crossings(i, off):
        x = 1090
        return way(i, [(x - off, 30), (x - off, 70), (x - off, 90), (x + off, 90), (x + off, 30)])

    trips = spark.createDataFrame([trip(1, line)], TRIP)
    ways = spark.createDataFrame([crossings(1, 20), crossings(2, 40), crossings(3, 40)], WAY)
    rows = stress.dissolved_parts(trips, ways).collect()
    assert sorted((round(r["rings"][0][0]["x"]), round(r["sum_seg_area"])) for r in rows) == [
        (1048, 64), (1068, 32), (1108, 32), (1128, 64)]


def test_no_regions_of_nothing(spark):
    empty = spark.createDataFrame([], TRIP)
    assert stress.dissolved_parts(empty, spark.createDataFrame([way(1, [(0, 0), (9, 0)])], WAY)).isEmpty()
    far = spark.createDataFrame([trip(1, [(0, 4), (9, 4)])], TRIP)  # buffers touch in a line only
    assert O.overlap_regions(far, spark.createDataFrame([way(1, [(0, 0), (9, 0)])], WAY)).isEmpty()


def test_parts_of_streets_with_corners_and_without_a_class(spark):
    # two streets without a class share their region with one that has a class; the fourth has its corner on the trip
    line = [(1000, 50), (1180, 50)]
    ways = spark.createDataFrame([way(1, line, lts=None), way(2, line, lts=None), way(3, line, lts="2"),
                                  way(4, [(1050, 0), (1050, 50), (1120, 120)])], WAY)
    rows = stress.dissolved_parts(spark.createDataFrame([trip(1, line)], TRIP), ways).collect()
    assert sorted((r["stress_lev"] or "", r["part"], round(r["area"]), round(r["sum_seg_area"])) for r in rows) == [
        ("", 0, 720, 1440), ("1", 0, 19, 19), ("2", 0, 720, 720)]  # 8 below, 11.31 aslant, 1.41 in the corner, less 1.66 twice covered


def test_regions_compute_their_python_columns_once(spark):
    # streets with a corner and without, so that pieces are filtered before they are measured; a class is missing
    ways = spark.createDataFrame([
        way(1, [(1000, 50), (1180, 50)], lts=None), way(2, [(1050, 0), (1050, 100), (1090, 140)]), way(3, [(1000, 52), (1180, 52)])], WAY)
    trips = spark.createDataFrame([trip(1, [(1000, 50), (1100, 50), (1100, 90)]), trip(2, [(1000, 500), (1100, 500)])], TRIP)
    regions = O.overlap_regions(trips, ways)
    plan = regions._jdf.queryExecution().optimizedPlan().treeString()
    assert plan.count("ArrowEvalPython") == 2
    rows = {r["osm_id"]: (r["hname"], r["stress_lev"], len(r["parts"]), r["seg_area"]) for r in regions.collect()}
    areas = {r["osm_id"]: r["seg_area"] for r in O.overlap(trips, ways).filter("seg_area > 0").collect()}
    assert set(rows) == set(areas) == {"1", "2", "3"}
    assert rows["1"][:3] == ("Street 1", None, 1)
    assert {k: r[3] for k, r in rows.items()} == pytest.approx(areas, abs=1e-2)


# ---------------------------------------------------------------- rolled-up quantiles

@pytest.mark.parametrize("max_bytes", [64 << 20, 0])
def test_rolled_up_quantiles_against_numpy(spark, monkeypatch, max_bytes):
    from streetflow.operators import quantiles
    keep = quantiles.broadcast_if_small
    monkeypatch.setattr(quantiles, "broadcast_if_small", lambda df: keep(df, max_bytes))
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), rng.choice([None, 0.0, -5.5, float(rng.randint(0, 900))]))
            for _ in range(600)]
    df = spark.createDataFrame(rows, "k string, m int, v double")
    sets = [["k"], ["k", "m"], []]
    got = {(r["grain"], r["k"], r["m"]): r for r in quantiles.rolled_up_quantiles(
        df, ["k", "m"], sets, "v", [0.25, 0.5, 0.75], ["p25", "p50", "p75"], mean="avg").collect()}
    want = {}
    for g, s in enumerate(sets):
        for k, m, v in rows:
            if v is not None:
                want.setdefault((g, k if "k" in s else None, m if "m" in s else None), []).append(v)
    assert set(got) == set(want)
    for key, values in want.items():
        np.testing.assert_allclose([got[key][c] for c in ("p25", "p50", "p75")], np.quantile(values, [0.25, 0.5, 0.75]))
        assert got[key]["avg"] == pytest.approx(np.mean(values))
    assert quantiles.rolled_up_quantiles(df.limit(0), ["k", "m"], sets, "v", [0.5], ["p50"]).isEmpty()


def test_groups_of_pieces_are_not_shuffled_and_straight_runs_are_one_piece(spark):
    trips = spark.createDataFrame([
        trip(1, [(0, 0), (50, 0), (120, 0)]), trip(1, [(0, 0), (120, 0)]), trip(2, [(0, 0), (100, 0), (100, 90)])], TRIP)
    ways = spark.createDataFrame([way(1, [(0, 1), (60, 1), (110, 1)]), way(1, [(100, 20), (100, 80)]), way(2, [(30, 40), (60, 40)])], WAY)
    pieces = O.touching_pieces(trips, ways, max_broadcast=0)
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(band#\d+, trip_id#\d+, osm_id", plan)
    # a trip in two rows and a street with a vertex on its way are one piece each
    assert {(len(r["a"]), len(r["b"])) for r in pieces.collect() if r["trip_id"] == "1"} == {(1, 1)}
    area, finer = ({(r["trip_id"], r["osm_id"]): r["seg_area"] for r in O.overlap(trips, ways, size=size).collect()}
                   for size in (200.0, 37.0))
    assert area["1", "1"] == pytest.approx(110 * 3) and area == pytest.approx(finer)


def test_trips_are_shuffled_to_cells_as_the_ends_of_their_pieces(spark):
    """Directions and boxes are made again after the shuffle, and names that nobody asks for are not shuffled."""
    ways = spark.createDataFrame([way(1, [(0, 0), (500, 30)]), way(2, [(150, -90), (150, 20), (260, 90)], lts="2"), way(3, [(400, 0), (400, 300)])], WAY)
    trips = spark.createDataFrame([trip(1, [(10, 1), (450, 25)]), trip(2, [(140, -80), (152, 15), (300, 90)]), trip(3, [(402, 310), (401, 5)])], TRIP)
    left = O._trip_cells(trips, 200.0)
    bare = O._stripped(left)
    assert bare.columns == ["band", "trip_id", "cx", "cy", "a"] and bare.schema["a"].dataType.elementType.names == list(G.SEGMENT)

    def rows(df):
        return sorted(map(repr, df.select(*sorted(df.columns)).collect()))

    assert rows(O._restored(bare)) == rows(left)
    spread = O.touching_pieces(trips, ways, max_broadcast=0, share=4)
    assert "RepartitionByExpression [cx" in spread._jdf.queryExecution().optimizedPlan().toString()
    plain = ["band", "trip_id", "osm_id", "stress_lev", "seg_area", "shape"]
    named, unnamed = O.overlap(trips, ways), O.overlap(trips, ways, max_broadcast=0, share=4, named=False)
    assert unnamed.columns == plain and rows(unnamed) == rows(named.select(*plain))


def test_vertices_on_a_straight_run_are_dropped_and_turns_are_kept(spark):
    lines = {
        "run": ([(0, 0), (1, 0), (1, 0), (2, 0), (5, 0)], [(0, 0), (5, 0)]), "back": ([(0, 0), (5, 0), (2, 0)], [(0, 0), (5, 0), (2, 0)]),
        "bend": ([(0, 0), (1, 1), (2, 2), (2, 3)], [(0, 0), (2, 2), (2, 3)]), "point": ([(1, 1), (1, 1)], [(1, 1)])}
    df = spark.createDataFrame([(k, [tuple(map(float, p)) for p in v]) for k, (v, _) in lines.items()], f"k string, geom {LINE}")
    got = {r["k"]: [(p["x"], p["y"]) for p in r["g"]] for r in df.select("k", G.straightened(F.col("geom")).alias("g")).collect()}
    assert got == {k: [tuple(map(float, p)) for p in want] for k, (_, want) in lines.items()}


def test_few_splits_of_the_street_table_are_dealt_out(spark):
    assert synthetic.ways(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_filter_on_the_angle_does_not_repeat_the_nearest_points(spark):
    trips, ways = synthetic.trips(spark, SF), classify.with_cycleable(synthetic.ways(spark, SF))
    plan = direction.segment_direction(trips, ways).filter(direction.is_contraflow())._jdf.queryExecution().optimizedPlan().toString()
    # each nearest point is the least of an array, for both ends of a piece, in one place
    assert plan.count("array_min") == 0 or max(line.count("array_min(transform(pieces") for line in plan.splitlines()) <= 2
    assert sum("array_min(transform(pieces" in line for line in plan.splitlines()) <= 1
