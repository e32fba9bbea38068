"""DuckDB SQL giving the same rows as the catalogue.

Lines are axis-aligned, so a buffer is a rectangle, an overlap is a rectangle intersection, and a clip
is an interval; no geometry code is shared with the Spark side.
"""

from __future__ import annotations

from types import SimpleNamespace

# Fixed values of EPSG:26986 on GRS80, stated for themselves: false origin, semi-major axis, eccentricity, and the
# cone constant, scale and origin radius that follow from the parallels 41 43' and 42 41' and the latitude 41.
P = SimpleNamespace(
    FALSE_EASTING=200000.0, FALSE_NORTHING=750000.0, SEMI_MAJOR=6378137.0, ECC=0.08181919104281579,
    CONE=0.6717286739214166, SCALE_F=1.902249000550368, RHO_0=7177701.74044719, ORIGIN_LON=-1.2479104151759457)

BX, BY = 230000, 890000
BANDS = "['00_140','141_320','321_384','384_500']"
CLASSES = ["1", "2", "3", "4", "11"]

WAYS = """
ext AS (SELECT 160 * (count(*) // 80) AS e FROM part),
w0 AS (
  SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS osm_id, p_partkey % 2 AS orient,
         100 * ((p_partkey // 2) % 40) AS off, 160 * (p_partkey // 80) AS a0, 160 * (p_partkey // 80) + 160 AS a1,
         CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN 'Round Circle ' || p_partkey
              ELSE 'Street ' || p_partkey END AS name,
         CASE p_partkey % 12 WHEN 0 THEN 'motorway' WHEN 1 THEN 'motorway_link' WHEN 2 THEN 'trunk'
              WHEN 3 THEN 'service' WHEN 4 THEN 'cycleway' WHEN 5 THEN 'footway' WHEN 6 THEN NULL
              WHEN 7 THEN 'unclassified' WHEN 8 THEN 'pedestrian' ELSE 'residential' END AS highway,
         CASE p_partkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS oneway,
         CASE WHEN p_partkey % 15 = 0 THEN 'yes' END AS divided,
         CASE p_partkey % 7 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '3' WHEN 4 THEN '11' WHEN 5 THEN NULL
              ELSE '4' END AS lts,
         CAST(p_partkey % 4 + 1 AS VARCHAR) AS lanes,
         CASE WHEN p_partkey % 29 = 0 THEN 'no' WHEN p_partkey % 4 = 0 THEN 'yes' END AS bicycle,
         CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN '"power"=>"line"'
              WHEN p_partkey % 19 = 0 THEN '"railway"=>"rail"' WHEN p_partkey % 23 = 0 THEN '"bicycle"=>"yes"'
              WHEN p_partkey % 29 = 0 THEN '"bicycle"=>"no"' WHEN p_partkey % 31 = 0 THEN '"cycleway:both"=>"no"'
              WHEN p_partkey % 37 = 0 THEN '"boundary"=>"administrative"'
              WHEN p_partkey % 41 = 0 THEN '"note"=>"Interstate ramp"' WHEN p_partkey % 43 = 0 THEN '"barrier"=>"fence"'
              ELSE '"surface"=>"asphalt"' END AS other_tags
  FROM part),
ways AS (
  SELECT *, CASE WHEN k % 24 = 0 THEN 'prohibited' ELSE lts END AS stress_lev,
    CASE WHEN lts = '4' AND (highway IS NULL OR regexp_matches(lower(other_tags),
      'power|cable|ownership|boundary|water|railway|barrier|fence|underground|pipeline')) THEN 'not' END AS cycleable,
    CASE orient WHEN 0 THEN a0 ELSE off - 2 END AS bx0, CASE orient WHEN 0 THEN a1 ELSE off + 2 END AS bx1,
    CASE orient WHEN 0 THEN off - 2 ELSE a0 END AS by0, CASE orient WHEN 0 THEN off + 2 ELSE a1 END AS by1,
    oneway = 'yes' AND divided IS NULL AND highway NOT ILIKE 'motorway%' AND highway NOT ILIKE 'trunk%'
      AND highway NOT ILIKE 'service' AND highway NOT ILIKE 'cycleway'
      AND name IS NOT NULL AND name NOT ILIKE '%circle%' AS simple
  FROM w0)"""

TRIPS = f"""
t0 AS (
  SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS trip_id, o_orderkey % 2 AS orient,
         60 + o_orderkey % 900 AS len, 100 * ((o_orderkey // 2) % 40) + o_orderkey % 6 AS off,
         (37 * o_orderkey) % e AS s, o_orderkey % 7 = 0 AS rev,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'scooter' ELSE 'bicycle' END AS vehicle_type,
         CASE WHEN o_orderstatus = 'P' THEN 'human' ELSE 'electric' END AS propulsion_type,
         CASE WHEN o_orderkey % 211 <> 0 THEN o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) END AS start_time,
         'q' || quarter(o_orderdate) || '_' || (2018 + year(o_orderdate) % 2) AS quart_year,
         CAST(60 + o_orderkey % 900 AS DOUBLE) AS dist_calc,
         CAST(CASE WHEN o_orderkey % 10 = 0 THEN (60 + o_orderkey % 900) // 5 ELSE 60 + o_orderkey % 900 END AS DOUBLE)
           AS od_line_dist,
         round(o_totalprice) % 100 AS matching_error
  FROM orders, ext),
t1 AS (
  SELECT *, CASE WHEN rev THEN s + len ELSE s END AS af, CASE WHEN rev THEN s ELSE s + len END AS at_,
    CASE orient WHEN 0 THEN s ELSE off - 2 END AS bx0, CASE orient WHEN 0 THEN s + len ELSE off + 2 END AS bx1,
    CASE orient WHEN 0 THEN off - 2 ELSE s END AS by0, CASE orient WHEN 0 THEN off + 2 ELSE s + len END AS by1
  FROM t0),
t2 AS (
  SELECT *, {BX} + CASE orient WHEN 0 THEN af ELSE off END AS sx, {BY} + CASE orient WHEN 0 THEN off ELSE af END AS sy,
    {BX} + CASE orient WHEN 0 THEN at_ ELSE off END AS ex, {BY} + CASE orient WHEN 0 THEN off ELSE at_ END AS ey
  FROM t1),
trips AS (
  SELECT t2.*, {BANDS}[CAST((k + c.i) % 4 + 1 AS INTEGER)] AS band
  FROM t2, (VALUES (0), (1)) c(i) WHERE c.i = 0 OR k % 50 = 0)"""

ROUTES = f"""
routes AS (
  SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS trip_id, {BANDS}[CAST(o_orderkey % 4 + 1 AS INTEGER)] AS band,
    CAST(60 + o_orderkey % 900 AS DOUBLE) AS dist_calc,
    CAST(CASE WHEN o_orderkey % 10 = 0 THEN (60 + o_orderkey % 900) // 5 ELSE 60 + o_orderkey % 900 END AS DOUBLE)
      AS od_line_dist,
    round(o_totalprice) % 100 AS matching_error,
    CASE WHEN o_orderstatus = 'P' THEN 'human' ELSE 'electric' END AS propulsion_type,
    CAST((60 + o_orderkey % 900) * 100 AS DOUBLE) / (95 + o_orderkey % 400) AS f_distance,
    CASE WHEN o_orderkey % 97 = 0 THEN 'inf' WHEN o_orderkey % 89 = 0 THEN '-999999'
      ELSE ((95 + o_orderkey % 400) // 100) || '.' || lpad(CAST((95 + o_orderkey % 400) % 100 AS VARCHAR), 2, '0')
      END AS ratio_text,
    o_orderkey % 2 AS orient, 100 * ((o_orderkey // 2) % 40) AS off, (37 * o_orderkey) % e AS s,
    ((60 + o_orderkey % 900) * 100) // (95 + o_orderkey % 400) AS flen
  FROM orders, ext),
clean AS (
  SELECT *, CAST(ratio_text AS DOUBLE) AS dist_ratio,
    CASE WHEN ratio_text NOT IN ('-999999', 'inf') THEN CAST(ratio_text AS DOUBLE) END AS safe_ratio FROM routes)"""

AREAS = f"""
areas AS (
  SELECT n_name AS municipal, n_nationkey % 3 = 0 AS chosen,
    (n_nationkey % 5) * (e // 5) + 37 AS x0, (n_nationkey % 5) * (e // 5) + 37 + e // 5 AS x1,
    (n_nationkey // 5) * 800 + 53 AS y0, (n_nationkey // 5) * 800 + 853 AS y1
  FROM nation, ext)"""


def overlaps(prefix: str, source: str) -> str:
    """Rectangle intersections of ``source`` (k, bx0..by1) with ridden streets, and areas per class."""
    areas = ", ".join(
        f"sum(CASE WHEN stress_lev = '{c}' THEN area END) AS area_{c}" for c in CLASSES
    ) + ", sum(CASE WHEN stress_lev IS NULL THEN area END) AS area_other"
    return f"""
{prefix}r AS (
  SELECT t.k, w.osm_id, w.name AS hname, w.lts AS stress_lev,
    greatest(t.bx0, w.bx0) AS x0, least(t.bx1, w.bx1) AS x1, greatest(t.by0, w.by0) AS y0, least(t.by1, w.by1) AS y1
  FROM {source} t JOIN ways w ON w.bx0 <= t.bx1 AND w.bx1 >= t.bx0 AND w.by0 <= t.by1 AND w.by1 >= t.by0
  WHERE w.cycleable IS NULL),
{prefix}o AS (SELECT *, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS seg_area FROM {prefix}r),
{prefix}d AS (
  SELECT k, x0, y0, x1, y1, stress_lev, max(seg_area) AS area, sum(seg_area) AS sum_seg_area
  FROM {prefix}o GROUP BY k, x0, y0, x1, y1, stress_lev),
{prefix}c AS (SELECT k, {areas} FROM {prefix}d WHERE sum_seg_area > 50 GROUP BY k)"""


TOTAL_AREA = " + ".join(f"coalesce(area_{c}, 0)" for c in [*CLASSES, "other"])


def lengths(name: str, source: str, classes: str, length: str) -> str:
    """``source`` left-joined with its class areas, with area, width_avg and len_*."""
    lens = ", ".join(f"area_{c} / nullif(width_avg, 0) AS len_{c}" for c in CLASSES)
    return f"""
{name}a AS (
  SELECT s.*, c.* EXCLUDE (k), {TOTAL_AREA} AS area,
    CASE WHEN s.{length} > 0 THEN ({TOTAL_AREA}) / s.{length} END AS width_avg
  FROM {source} s LEFT JOIN {classes} c ON s.k = c.k),
{name} AS (SELECT *, {lens} FROM {name}a)"""


ROUTE_BOX = """
rbox AS (
  SELECT *, CAST(flen AS DOUBLE) AS sh_net_dist_calc,
    CASE orient WHEN 0 THEN s ELSE off - 2 END AS bx0, CASE orient WHEN 0 THEN s + flen ELSE off + 2 END AS bx1,
    CASE orient WHEN 0 THEN off - 2 ELSE s END AS by0, CASE orient WHEN 0 THEN off + 2 ELSE s + flen END AS by1
  FROM clean)"""

ACTUAL = ",".join([WAYS, TRIPS, overlaps("a", "t1"), lengths("actual", "trips", "ac", "dist_calc")])
SHORTEST = ",".join([WAYS, ROUTES, ROUTE_BOX, overlaps("s", "rbox"),
                     lengths("shortest", "rbox", "sc", "sh_net_dist_calc")])
PAIRS = ",".join([
    ACTUAL, ROUTES, ROUTE_BOX, overlaps("s", "rbox"), lengths("shortest", "rbox", "sc", "sh_net_dist_calc"),
    f"""
pairs AS (
  SELECT t.trip_id, s.band, t.propulsion_type, t.dist_calc, t.start_time,
    {", ".join(f"t.len_{c}" for c in CLASSES)}, s.sh_net_dist_calc, s.dist_ratio,
    {", ".join(f"s.len_{c} AS sh_len_{c}" for c in CLASSES)}
  FROM shortest s LEFT JOIN actual t ON s.trip_id = t.trip_id AND s.band = t.band),
filled AS (
  SELECT trip_id, band, dist_calc, start_time, dist_ratio, sh_net_dist_calc,
    {", ".join(f"coalesce(len_{c}, 0) AS len_{c}, coalesce(sh_len_{c}, 0) AS sh_len_{c}" for c in CLASSES)} FROM pairs),
study AS (
  SELECT *, len_1 / dist_calc AS len_1_p, len_2 / dist_calc AS len_2_p, (len_1 + len_11) / dist_calc AS len_1_11_p,
    (len_1 + len_2 + len_11) / dist_calc AS len_1_2_11_p, len_3 / dist_calc AS len_3_p, len_4 / dist_calc AS len_4_p,
    CASE WHEN dayname(start_time) IN ('Saturday', 'Sunday') THEN 'weekend'
         WHEN hour(start_time) IN (7, 8, 9, 16, 17, 18) THEN 'weekday_peak' ELSE 'weekday_nonpeak' END AS day_type
  FROM filled
  QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY list_position({BANDS}, band)) = 1)"""])

DIRECTION = ",".join([WAYS, TRIPS, f"""
good AS (SELECT * FROM trips WHERE vehicle_type = 'bicycle' AND matching_error < 70),
tseg AS (
  SELECT *, af AS a, at_ AS b FROM good WHERE k % 3 <> 0
  UNION ALL SELECT *, af, s + len // 2 FROM good WHERE k % 3 = 0
  UNION ALL SELECT *, s + len // 2, at_ FROM good WHERE k % 3 = 0),
ow AS (SELECT * FROM ways WHERE cycleable IS NULL AND oneway = 'yes'),
cut AS (
  SELECT t.band, t.trip_id, t.vehicle_type, t.propulsion_type, t.orient, t.off, t.a, t.b,
    w.osm_id, w.name, w.highway, w.lanes, w.a0, true AS along,
    greatest(least(t.a, t.b), w.a0) AS lo, least(greatest(t.a, t.b), w.a1) AS hi
  FROM tseg t JOIN ow w ON t.orient = w.orient AND abs(t.off - w.off) <= 2
  UNION ALL
  SELECT t.band, t.trip_id, t.vehicle_type, t.propulsion_type, t.orient, t.off, t.a, t.b,
    w.osm_id, w.name, w.highway, w.lanes, w.a0, false,
    greatest(least(t.a, t.b), w.off - 2), least(greatest(t.a, t.b), w.off + 2)
  FROM tseg t JOIN ow w ON t.orient <> w.orient AND t.off BETWEEN w.a0 AND w.a1),
ends AS (
  SELECT *, CASE WHEN a < b THEN lo ELSE hi END AS p, CASE WHEN a < b THEN hi ELSE lo END AS q FROM cut WHERE hi > lo),
frac AS (
  SELECT *, CASE WHEN along THEN 0.0 END AS angle,
    CAST(CASE WHEN along THEN p - a0 ELSE off - a0 END AS DOUBLE) / 160 AS f1,
    CAST(CASE WHEN along THEN q - a0 ELSE off - a0 END AS DOUBLE) / 160 AS f2 FROM ends),
segs AS (
  SELECT *, CASE WHEN f1 > f2 THEN angle + 180 ELSE angle END AS angle_mod,
    CASE WHEN f1 > f2 THEN angle + 180 ELSE angle END AS angle_mod_1, CAST(abs(q - p) AS DOUBLE) AS seg_len FROM frac),
contra AS (SELECT * FROM segs WHERE angle_mod_1 BETWEEN 170 AND 190 AND seg_len > 10),
same AS (
  SELECT * FROM segs WHERE seg_len > 10 AND angle_mod_1 BETWEEN 0 AND 10 OR angle_mod_1 BETWEEN 350 AND 360),
wrong AS (SELECT DISTINCT trip_id FROM contra WHERE osm_id IN (SELECT osm_id FROM ways WHERE simple))"""])


def _band_columns() -> str:
    out = []
    for b in ["00_140", "141_320", "321_384", "384_500"]:
        for way in ("contra", "same"):
            out.append(f"(SELECT sum(seg_len) FROM {way} x WHERE x.osm_id = w.osm_id AND x.band = '{b}') AS {way}_tot_m_{b}")
            out.append(f"(SELECT count(DISTINCT trip_id) FROM {way} x WHERE x.osm_id = w.osm_id AND x.band = '{b}') "
                       f"AS {way}_cnt_{b}")
    return ", ".join(out)


def _over_bands(column: str) -> str:
    return " + ".join(f"coalesce({column}_{b}, 0)" for b in ["00_140", "141_320", "321_384", "384_500"])


TOTALS = DIRECTION + f""",
tot0 AS (SELECT w.osm_id, w.name, w.highway, w.simple, w.bx0, w.bx1, w.by0, w.by1, w.orient, w.off, w.a0, w.a1,
  {_band_columns()} FROM ow w),
tot AS (SELECT *, {_over_bands("contra_tot_m")} AS tot_m_contra, {_over_bands("same_tot_m")} AS tot_m_same,
  CAST({_over_bands("contra_cnt")} AS BIGINT) AS tot_cnt_contra, CAST({_over_bands("same_cnt")} AS BIGINT) AS tot_cnt_same
  FROM tot0)"""

AREA_TRIPS = """
atrips AS (
  SELECT DISTINCT t.trip_id, t.dist_calc FROM good t JOIN areas m ON m.chosen
    AND least(t.sx, t.ex) - 230000 <= m.x1 AND greatest(t.sx, t.ex) - 230000 >= m.x0
    AND least(t.sy, t.ey) - 890000 <= m.y1 AND greatest(t.sy, t.ey) - 890000 >= m.y0)"""


def lonlat(source: str, x: str, y: str, lon: str, lat: str) -> str:
    """``source`` with degrees of (x, y): inverse conic, six fixed-point steps."""
    inner = f"""(SELECT *, power(sqrt(pow({x} - {P.FALSE_EASTING}, 2) + pow({P.RHO_0!r} - ({y} - {P.FALSE_NORTHING}), 2))
        / {P.SEMI_MAJOR * P.SCALE_F!r}, {1 / P.CONE!r}) AS tt FROM {source})"""
    inner = f"(SELECT *, pi() / 2 - 2 * atan(tt) AS ph FROM {inner})"
    for _ in range(6):
        es = f"({P.ECC!r} * sin(ph))"
        inner = (f"(SELECT * EXCLUDE (ph), pi() / 2 - 2 * atan(tt * power((1 - {es}) / (1 + {es}), {P.ECC / 2!r})) AS ph "
                 f"FROM {inner})")
    return (f"(SELECT * EXCLUDE (tt, ph), degrees(ph) AS {lat}, degrees(atan2({x} - {P.FALSE_EASTING}, "
            f"{P.RHO_0!r} - ({y} - {P.FALSE_NORTHING})) / {P.CONE!r} + {P.ORIGIN_LON!r}) AS {lon} FROM {inner})")


#: Least distances on the grid by keyed recursion. Streets run along the axes, so |dx| + |dy| never exceeds the way that
#: is left. Routes are sought up to SPARE metres longer than that, those not found there up to MORE. Positions are whole metres.
SPARE, MORE = 300, 3000


def _distances(name: str, goals: str) -> str:
    return f"""{name}(pair, x, y, d) USING KEY (pair, x, y) AS (
  SELECT pair, x, y, min(rest) FROM od JOIN tip ON px = sx AND py = sy WHERE pair IN (SELECT pair FROM ({goals})) GROUP BY 1, 2, 3
  UNION
  (SELECT c.pair, l.x2, l.y2, min(c.d + l.len) FROM {name} c JOIN ({goals}) g ON g.pair = c.pair JOIN link l ON l.x = c.x AND l.y = c.y
   LEFT JOIN recurring.{name} r ON r.pair = c.pair AND r.x = l.x2 AND r.y = l.y2
   WHERE c.d + l.len + abs(l.x2 - tx) + abs(l.y2 - ty) <= bound AND (r.d IS NULL OR c.d + l.len < r.d) GROUP BY 1, 2, 3))"""


def _arrivals(name: str, dist: str, pairs: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT pair, min(m) AS m FROM (
    SELECT pair, NULL::BIGINT AS m FROM ({pairs})
    UNION ALL SELECT od.pair, d + rest FROM od JOIN tip ON px = ex AND py = ey JOIN {dist} t ON t.pair = od.pair AND t.x = tip.x AND t.y = tip.y
    UNION ALL SELECT od.pair, abs(o.qx - t.qx) + abs(o.qy - t.qy) FROM od JOIN tip o ON o.px = sx AND o.py = sy
      JOIN tip t ON t.px = ex AND t.py = ey AND t.k = o.k) WHERE pair IN (SELECT pair FROM ({pairs})) GROUP BY pair)"""


ROUTED = f"""
net AS (SELECT k, orient, off, a0, a1 FROM ways WHERE highway IS NOT NULL AND highway NOT IN ('motorway', 'motorway_link')),
vert AS (
  SELECT k, orient, off, unnest(list_distinct(list_filter([a0, 100 * (a0 // 100 + 1), 100 * (a0 // 100 + 2), a1], lambda v: v <= a1))) AS a
  FROM net),
node AS (
  SELECT k, a, {BX} + CASE orient WHEN 0 THEN a ELSE off END AS x, {BY} + CASE orient WHEN 0 THEN off ELSE a END AS y FROM vert),
along AS (SELECT k, a, x, y, lead(a) OVER w AS b, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM node WINDOW w AS (PARTITION BY k ORDER BY a)),
link AS MATERIALIZED (
  SELECT x, y, x2, y2, b - a AS len FROM along WHERE b IS NOT NULL UNION SELECT x2, y2, x, y, b - a FROM along WHERE b IS NOT NULL),
od AS MATERIALIZED (SELECT row_number() OVER () AS pair, * FROM (SELECT DISTINCT sx, sy, ex, ey FROM trips)),
pt AS (SELECT sx AS px, sy AS py FROM od UNION SELECT ex, ey FROM od),
foot AS (
  SELECT px, py, arg_min(struct_pack(k := k, qx := qx, qy := qy), ((px - qx) * (px - qx) + (py - qy) * (py - qy), qx, qy, k)) AS q
  FROM (SELECT px, py, k, CASE orient WHEN 0 THEN greatest({BX} + a0, least({BX} + a1, px)) ELSE {BX} + off END AS qx,
               CASE orient WHEN 0 THEN {BY} + off ELSE greatest({BY} + a0, least({BY} + a1, py)) END AS qy FROM pt, net)
  GROUP BY px, py),
tip AS MATERIALIZED (
  SELECT DISTINCT f.px, f.py, q.k AS k, q.qx AS qx, q.qy AS qy, n.x, n.y, abs(n.x - q.qx) + abs(n.y - q.qy) AS rest
  FROM foot f JOIN node n ON n.k = q.k
  QUALIFY rest = min(CASE WHEN n.x <= q.qx AND n.y <= q.qy THEN rest END) OVER (PARTITION BY f.px, f.py)
       OR rest = min(CASE WHEN n.x >= q.qx AND n.y >= q.qy THEN rest END) OVER (PARTITION BY f.px, f.py)),
goal AS MATERIALIZED (
  SELECT DISTINCT od.pair, t.qx AS tx, t.qy AS ty, abs(o.qx - t.qx) + abs(o.qy - t.qy) + {SPARE} AS bound
  FROM od JOIN tip o ON o.px = sx AND o.py = sy JOIN tip t ON t.px = ex AND t.py = ey),
{_distances("d1", "SELECT * FROM goal")},
{_arrivals("f1", "d1", "SELECT pair FROM od")},
{_distances("d2", f"SELECT pair, tx, ty, bound + {MORE} AS bound FROM goal WHERE pair NOT IN (SELECT pair FROM f1 WHERE m IS NOT NULL)")},
{_arrivals("f2", "d2", "SELECT pair FROM f1 WHERE m IS NULL")},
found AS (SELECT sx, sy, ex, ey, coalesce(f1.m, f2.m) AS m FROM od JOIN f1 USING (pair) LEFT JOIN f2 USING (pair))"""


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def r(column: str, digits: int = 6, name: str | None = None) -> str:
    return f"round({column}, {digits}) AS {name or column}"


LEN_R = ", ".join(r(f"len_{c}") for c in CLASSES)
SH_R = ", ".join(r(f"sh_len_{c}") for c in CLASSES)
AREA_R = ", ".join(r(f"area_{c}") for c in [*CLASSES, "other"])
BOTH_ENDS = lonlat(lonlat("trips", "sx", "sy", "lon_o", "lat_o"), "ex", "ey", "lon_d", "lat_d")
BOTH_ENDS_ONCE = lonlat(lonlat("t2", "sx", "sy", "lon_o", "lat_o"), "ex", "ey", "lon_d", "lat_d")
STATS = """avg(dist_calc) AS dist_avg, quantile_cont(dist_calc, 0.25) AS p25, quantile_cont(dist_calc, 0.5) AS p50,
  quantile_cont(dist_calc, 0.75) AS p75"""
STATS_R = ", ".join(r(c) for c in ("dist_avg", "p25", "p50", "p75"))
LENGTH_TRIPS = ",".join([WAYS, TRIPS, """
uni AS (SELECT DISTINCT trip_id, vehicle_type, propulsion_type, dist_calc, CAST(month(start_time) AS INTEGER) AS month,
          quart_year FROM trips),
chosen AS (SELECT * FROM uni WHERE quart_year IN ('q2_2018','q3_2018','q4_2018','q1_2019','q2_2019','q3_2019'))"""])
VALID = "valid AS (SELECT * FROM clean WHERE safe_ratio > 0.98 AND safe_ratio < 1000)"
NONLOOP = """
loops AS (SELECT trip_id FROM clean WHERE od_line_dist < 401 AND dist_calc > 3 * od_line_dist),
nonloop AS (SELECT * FROM clean WHERE trip_id NOT IN (SELECT trip_id FROM loops) AND dist_calc > 100)"""
RC = WAYS + "," + ROUTES
SHARE_R = ", ".join(f"round(sum(len_{c}) / sum(dist_calc), 6) AS len_{c}" for c in CLASSES)
DETOUR = "CASE WHEN dist_ratio <= 1.25 THEN '125' WHEN dist_ratio > 2 THEN '200' END"


def _share_table() -> str:
    cells = []
    for day, short in (("weekend", "wnd"), ("weekday_peak", "wp"), ("weekday_nonpeak", "wnp")):
        for d in ("125", "200"):
            value = "CASE lts " + " ".join(f"WHEN '{c}' THEN len_{c}" for c in CLASSES) + " END"
            cells.append(f"round(sum(CASE WHEN day_type = '{day}' AND {DETOUR} = '{d}' THEN {value} END) / "
                         f"sum(CASE WHEN day_type = '{day}' AND {DETOUR} = '{d}' THEN dist_calc END), 6) AS {short}_{d}")
    return with_(PAIRS, f"SELECT lts, {', '.join(cells)} FROM study, "
                        f"(VALUES ('1'), ('2'), ('3'), ('4'), ('11')) v(lts) GROUP BY lts")


def by_street(name: str) -> str:
    return (f"SELECT band, osm_id, min(name) AS name, count(DISTINCT trip_id) AS cnt, sum(seg_len) AS tot_m "
            f"FROM {name} GROUP BY band, osm_id")


ORACLES: dict[str, str] = {
    "trip_endpoints": with_(WAYS + "," + TRIPS, f"""
SELECT trip_id, band, dist_calc, od_line_dist, matching_error, propulsion_type, {r("lon_o", 7)}, {r("lat_o", 7)},
  {r("lon_d", 7)}, {r("lat_d", 7)} FROM {BOTH_ENDS} WHERE vehicle_type = 'bicycle' AND matching_error < 70"""),
    "od_line_distance": with_(WAYS + "," + TRIPS, f"""
SELECT trip_id, band, round(sqrt(pow(ex - sx, 2) + pow(ey - sy, 2)), 4) AS od_line_dist FROM trips"""),
    "line_measures": with_(WAYS + "," + TRIPS, """
SELECT trip_id, band, CAST(sx AS DOUBLE) AS sx, CAST(sy AS DOUBLE) AS sy, CAST(ex AS DOUBLE) AS ex,
  CAST(ey AS DOUBLE) AS ey, CAST(len AS DOUBLE) AS length, CAST(len AS DOUBLE) AS straight FROM trips"""),
    "street_buffer_area": with_(WAYS, """
SELECT osm_id, CAST(1 + (SELECT count(*) FROM range(0, 41) g(i)
    WHERE 100 * (a0 // 100) + 100 * i > a0 AND 100 * (a0 // 100) + 100 * i < a1) AS BIGINT) AS pieces,
  CAST((a1 - a0) * 4 AS DOUBLE) AS area FROM ways"""),
    "area_outline": with_(WAYS + "," + AREAS + f""",
corner AS (SELECT municipal, x0 + {BX} AS x, y0 + {BY} AS y, (x1 - x0) * (y1 - y0) AS area FROM areas)""", f"""
SELECT municipal, CAST(area AS DOUBLE) AS area, {r("lon", 7)}, {r("lat", 7)} FROM {lonlat("corner", "x", "y", "lon", "lat")}"""),
    "street_class_tags": with_(WAYS, """
SELECT osm_id, CASE WHEN (highway IN ('proposed','construction','footway','path','pedestrian','steps','bridleway','platform')
   AND NOT regexp_matches(lower(other_tags), 'bicycle"=>"(yes|designated|official|permissive|destination)'))
   OR other_tags ILIKE '%bicycle"=>"no"%' OR other_tags ILIKE '%cycleway:both%no%' THEN 'noncycleable' END AS cycle
FROM ways"""),
    "street_class_tags_loose": with_(WAYS, """
SELECT osm_id, CASE WHEN other_tags ILIKE '%bicycle"=>"no"%' THEN 'noncycleable' END AS cycle_1 FROM ways"""),
    "loose_network": with_(WAYS, """
SELECT osm_id, stress_lev, cycle_1 FROM (
  SELECT *, CASE WHEN other_tags ILIKE '%bicycle"=>"no"%' THEN 'noncycleable' END AS cycle_1 FROM ways)
WHERE stress_lev <> 'prohibited' OR cycle_1 IS NULL"""),
    "street_class_roads": with_(WAYS, """
SELECT osm_id, CASE WHEN highway IN ('motorway','motorway_link','trunk','unclassified') OR bicycle = 'no'
  THEN 'noncycleable' END AS cycle FROM ways"""),
    "cycleway_network": with_(WAYS, """
SELECT osm_id, highway, bicycle, other_tags FROM ways WHERE highway IS NOT NULL
  AND (bicycle NOT ILIKE 'no' OR bicycle IS NULL) AND other_tags NOT ILIKE '%boundary"=>"administrative%'
  AND other_tags NOT ILIKE '%railway"=>%' AND highway NOT ILIKE 'motor%' AND highway NOT ILIKE 'trunk'"""),
    "street_class_cyclable": with_(WAYS, "SELECT osm_id, lts, cycleable FROM ways"),
    "interstate_classes": with_(WAYS, "SELECT DISTINCT stress_lev FROM ways WHERE other_tags ILIKE '%interstate%'"),
    "lts_update_join": with_(WAYS, """
SELECT t.osm_id, CAST(w.lts AS INTEGER) AS lts FROM (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS osm_id FROM lineitem) t
LEFT JOIN ways w ON w.osm_id = t.osm_id AND w.k % 3 <> 1"""),
    "overlap_trip_street": with_(WAYS + "," + TRIPS + "," + overlaps("a", "t1"), """
SELECT t.band, t.trip_id, o.osm_id, o.hname, o.stress_lev, o.seg_area FROM ao o JOIN trips t ON t.k = o.k"""),
    "overlap_parts": with_(WAYS + "," + TRIPS + "," + overlaps("a", "t1"), """
SELECT t.band, t.trip_id, o.osm_id, o.seg_area AS area FROM ao o JOIN trips t ON t.k = o.k WHERE o.seg_area > 0"""),
    "overlap_dissolve": with_(WAYS + "," + TRIPS + "," + overlaps("a", "t1"), """
SELECT t.band, t.trip_id, o.stress_lev, o.area, o.sum_seg_area FROM ad o JOIN trips t ON t.k = o.k WHERE o.area > 0"""),
    "overlap_regions": with_(WAYS + "," + TRIPS + "," + overlaps("a", "t1"), """
SELECT t.band, t.trip_id, o.osm_id, o.hname, o.stress_lev, o.seg_area, CAST(1 AS BIGINT) AS parts,
  CAST(4 AS BIGINT) AS corners, CAST(2 * (o.x1 - o.x0 + o.y1 - o.y0) AS DOUBLE) AS ring_m
FROM ao o JOIN trips t ON t.k = o.k WHERE o.seg_area > 0"""),
    "dissolved_parts": with_(WAYS + "," + TRIPS + "," + overlaps("a", "t1"), f"""
SELECT t.band, t.trip_id, o.stress_lev, CAST({BX} + o.x0 AS DOUBLE) AS x, CAST({BY} + o.y0 AS DOUBLE) AS y, o.area,
  CAST(2 * (o.x1 - o.x0 + o.y1 - o.y0) AS DOUBLE) AS ring_m, o.sum_seg_area
FROM ad o JOIN trips t ON t.k = o.k WHERE o.area > 0"""),
    "stress_area_by_trip": with_(ACTUAL, f"SELECT trip_id, band, {AREA_R} FROM actual"),
    "stress_len_by_trip": with_(ACTUAL, f"""
SELECT trip_id, band, vehicle_type, propulsion_type, dist_calc, matching_error, start_time, {AREA_R}, {r("area")},
  {r("width_avg")}, {LEN_R} FROM actual"""),
    "stress_len_shortest": with_(SHORTEST, f"""
SELECT trip_id, band, sh_net_dist_calc, ratio_text AS dist_ratio, {AREA_R}, {r("area")}, {r("width_avg")}, {LEN_R}
FROM shortest"""),
    "stress_len_pair": with_(PAIRS, f"""
SELECT trip_id, band, propulsion_type, dist_calc, start_time, {LEN_R}, sh_net_dist_calc, dist_ratio, {SH_R} FROM pairs"""),
    "street_trip_count": with_(WAYS + "," + TRIPS + "," + overlaps("a", "t1"), """
SELECT osm_id, max(hname) AS hname, sum(seg_area) AS sumarea_ovlp_trps, max(stress_lev) AS stress_lev,
  count(DISTINCT k) AS count FROM ao WHERE seg_area > 50 GROUP BY osm_id"""),
    "segment_direction": with_(DIRECTION, f"""
SELECT band, osm_id, name, highway, lanes, trip_id, vehicle_type, propulsion_type,
  CAST({BX} + CASE orient WHEN 0 THEN p ELSE off END AS DOUBLE) AS sx,
  CAST({BY} + CASE orient WHEN 0 THEN off ELSE p END AS DOUBLE) AS sy,
  CAST({BX} + CASE orient WHEN 0 THEN q ELSE off END AS DOUBLE) AS ex,
  CAST({BY} + CASE orient WHEN 0 THEN off ELSE q END AS DOUBLE) AS ey,
  CAST(angle AS DOUBLE) AS angle, {r("f1")}, {r("f2")}, CAST(angle_mod AS DOUBLE) AS angle_mod,
  CAST(angle_mod_1 AS DOUBLE) AS angle_mod_1, seg_len FROM segs"""),
    "segment_table": with_(DIRECTION, "SELECT band, osm_id, count(*) AS n, sum(seg_len) AS m FROM segs GROUP BY band, osm_id"),
    "contraflow_by_street": with_(DIRECTION, by_street("contra")),
    "samedir_by_street": with_(DIRECTION, by_street("same")),
    "samedir_by_street_strict": with_(DIRECTION, by_street(
        "(SELECT * FROM segs WHERE seg_len > 10 AND (angle_mod_1 BETWEEN 0 AND 10 OR angle_mod_1 BETWEEN 350 AND 360)) z")),
    "street_direction_totals": with_(TOTALS, """
SELECT osm_id, name, highway, contra_tot_m_00_140, same_tot_m_00_140, contra_tot_m_141_320, same_tot_m_141_320,
  contra_tot_m_321_384, same_tot_m_321_384, contra_tot_m_384_500, same_tot_m_384_500,
  tot_m_contra, tot_m_same, tot_cnt_contra, tot_cnt_same FROM tot"""),
    "contraflow_totals": with_(TOTALS, """
SELECT osm_id AS osmid, name, tot_m_contra, tot_cnt_contra, tot_m_same, tot_cnt_same, highway FROM tot WHERE simple"""),
    "saved_contraflow_totals": with_(TOTALS, """
SELECT osm_id AS osmid, name, tot_m_contra, tot_cnt_contra, tot_m_same, tot_cnt_same, highway, (SELECT count(*) FROM wrong) AS trips
FROM tot WHERE simple"""),
    "saved_stress_area": with_(ACTUAL, f"SELECT trip_id, band, {AREA_R} FROM actual"),
    "trips_with_contraflow": with_(DIRECTION, "SELECT trip_id FROM wrong"),
    "contraflow_trip_count": with_(DIRECTION, "SELECT count(*) AS trips FROM wrong"),
    "contraflow_metres": with_(TOTALS + "," + AREAS, """
SELECT sum(tot_m_contra) AS contraflow_m, sum(CASE WHEN EXISTS (SELECT 1 FROM areas m WHERE m.chosen
    AND CASE orient WHEN 0 THEN a0 ELSE off END <= m.x1 AND CASE orient WHEN 0 THEN a1 ELSE off END >= m.x0
    AND CASE orient WHEN 0 THEN off ELSE a0 END <= m.y1 AND CASE orient WHEN 0 THEN off ELSE a1 END >= m.y0)
  THEN tot_m_contra END) AS contraflow_m_in_areas FROM tot WHERE simple"""),
    "network_length_by_class": with_(WAYS + "," + AREAS + """,
inside AS (SELECT w.* FROM ways w JOIN areas m ON m.chosen
    AND CASE orient WHEN 0 THEN a0 ELSE off END >= m.x0 AND CASE orient WHEN 0 THEN a1 ELSE off END <= m.x1
    AND CASE orient WHEN 0 THEN off ELSE a0 END >= m.y0 AND CASE orient WHEN 0 THEN off ELSE a1 END <= m.y1)""", """
SELECT 'simple_one_way' AS class, CAST(sum(a1 - a0) AS DOUBLE) AS network_meters FROM inside WHERE simple
UNION ALL SELECT 'divided_one_way', CAST(sum(a1 - a0) AS DOUBLE) FROM inside WHERE divided = 'yes'
UNION ALL SELECT 'rest', CAST(sum(a1 - a0) AS DOUBLE) FROM inside WHERE (oneway IS NULL OR oneway <> 'yes')
  AND divided IS NULL AND cycleable IS NULL AND highway NOT ILIKE 'motorway%' AND other_tags NOT ILIKE '%railway"=>%'
  AND other_tags NOT ILIKE '%boundary"=>%' AND other_tags NOT ILIKE '%barrier%'"""),
    "area_trips": with_(DIRECTION + "," + AREAS + "," + AREA_TRIPS, "SELECT trip_id, dist_calc FROM atrips"),
    "area_metres": with_(DIRECTION + "," + AREAS + "," + AREA_TRIPS, """
SELECT sum(dist_calc) AS total_m, count(DISTINCT trip_id) AS trips FROM atrips"""),
    "area_contraflow_share": with_(DIRECTION + "," + AREAS + "," + AREA_TRIPS, """
SELECT count(*) AS trips, count(w.trip_id) AS contraflow_trips, round(count(w.trip_id) / count(*), 6) AS share
FROM (SELECT DISTINCT trip_id FROM atrips) a LEFT JOIN wrong w ON a.trip_id = w.trip_id"""),
    "route_merge_clean": with_(RC + f""",
ends AS (
  SELECT *, {BX} + CASE orient WHEN 0 THEN s ELSE off END AS sx, {BY} + CASE orient WHEN 0 THEN off ELSE s END AS sy,
    {BX} + CASE orient WHEN 0 THEN s + flen ELSE off END AS ex, {BY} + CASE orient WHEN 0 THEN off ELSE s + flen END AS ey
  FROM clean)""", f"""
SELECT trip_id, propulsion_type, dist_calc, od_line_dist, CASE WHEN band <> '384_500' THEN matching_error END AS matching_error,
  {", ".join(f"round(round({c}, 7), 6) AS {c}" for c in ("lon_o", "lat_o", "lon_d", "lat_d"))},
  {r("f_distance")}, dist_ratio, band, safe_ratio
FROM {lonlat(lonlat("ends", "sx", "sy", "lon_o", "lat_o"), "ex", "ey", "lon_d", "lat_d")}"""),
    "route_table_typed": with_(RC, f"SELECT trip_id, dist_calc, {r('f_distance')} FROM clean"),
    "shortest_paths": with_(WAYS + "," + TRIPS + "," + ROUTED, """
SELECT trip_id, band, dist_calc, CAST(m AS DOUBLE) AS f_distance, round(dist_calc / nullif(m, 0), 3) AS dist_ratio,
  CASE WHEN m IS NULL THEN 'unreachable' ELSE 'ok' END AS route_status, CAST(m AS DOUBLE) AS path_m
FROM trips JOIN found USING (sx, sy, ex, ey)""").replace("WITH", "WITH RECURSIVE", 1),
    "routed_features": with_(WAYS + "," + TRIPS + "," + ROUTED, """
SELECT 'feature' AS type, trip_id, dist_calc, CAST(m AS DOUBLE) AS f_distance, round(dist_calc / nullif(m, 0), 3) AS dist_ratio,
  propulsion_type, CAST(m AS DOUBLE) AS length
FROM trips JOIN found USING (sx, sy, ex, ey) WHERE m IS NOT NULL""").replace("WITH", "WITH RECURSIVE", 1),
    "nonloop_trips": with_(RC + "," + NONLOOP, """
SELECT trip_id, band, dist_calc, dist_ratio FROM nonloop WHERE dist_ratio >= 0.99"""),
    "below_network_length": with_(RC + "," + NONLOOP, """
SELECT trip_id, dist_calc, dist_ratio FROM nonloop WHERE dist_ratio < 0.99"""),
    "ratio_near_one": with_(RC, """
SELECT band, count(*) AS trips, count(CASE WHEN dist_ratio > 0.99999 AND dist_ratio < 1.00002 THEN 1 END) AS near_one
FROM clean GROUP BY band"""),
    "detour_histogram": with_(RC + "," + VALID + """,
h AS (SELECT b, count(*) AS n FROM valid JOIN range(97, 600) g(b)
      ON safe_ratio > (2 * b - 1) / 200 AND safe_ratio <= (2 * b + 1) / 200 GROUP BY b)""", """
SELECT round(b / 100, 6) AS ratio, n, round(n / (SELECT count(*) FROM valid), 6) AS share FROM h"""),
    "detour_bins_rel": with_(RC, """
SELECT round(b / 100, 6) AS lower, round((SELECT count(*) FROM clean WHERE dist_ratio > b / 100
  AND dist_ratio <= (b + 1) / 100) / (SELECT count(*) FROM clean), 6) AS share FROM range(98, 400) g(b)"""),
    "detour_bins_count": with_(RC + "," + VALID, """
SELECT b / 100 AS lower, (SELECT count(*) FROM valid WHERE safe_ratio >= b / 100 AND safe_ratio < (b + 1) / 100) AS trips
FROM range(98, 500) g(b)"""),
    "detour_quantiles": with_(RC + "," + VALID, """
SELECT count(*) AS n, round(avg(safe_ratio), 6) AS mean, round(quantile_cont(safe_ratio, 0.0), 6) AS q0,
  round(quantile_cont(safe_ratio, 0.25), 6) AS q25, round(quantile_cont(safe_ratio, 0.5), 6) AS q50,
  round(quantile_cont(safe_ratio, 0.75), 6) AS q75, round(quantile_cont(safe_ratio, 1.0), 6) AS q100 FROM valid"""),
    "low_stress_curve": with_(PAIRS + ", direct AS (SELECT * FROM study WHERE dist_ratio <= 1.25)", """
SELECT i / 1000 AS break, round(count(CASE WHEN len_1_2_11_p >= i / 1000 THEN 1 END) / count(*), 6) AS lts_2_less,
  round(count(CASE WHEN len_1_11_p >= i / 1000 THEN 1 END) / count(*), 6) AS lts_1_less
FROM direct, range(0, 1001) g(i) GROUP BY i"""),
    "stress_shares": with_(PAIRS, f"""
SELECT trip_id, band, {r("len_1_p")}, {r("len_2_p")}, {r("len_1_11_p")}, {r("len_1_2_11_p")}, {r("len_3_p")},
  {r("len_4_p")} FROM study"""),
    "stress_totals": with_(PAIRS, f"""
SELECT {", ".join(f"round(sum(len_{c}), 3) AS len_{c}, round(sum(sh_len_{c}), 3) AS sh_len_{c}" for c in CLASSES)},
  sum(dist_calc) AS dist_calc, sum(sh_net_dist_calc) AS sh_net_dist_calc, count(*) AS trips
FROM study WHERE dist_ratio <= 1.25"""),
    "trips_by_daytype": with_(PAIRS, "SELECT day_type, count(*) AS trips FROM study GROUP BY day_type"),
    "stress_share_by_daytype": with_(PAIRS, f"""
SELECT day_type, {DETOUR} AS detour, {SHARE_R} FROM study WHERE {DETOUR} IS NOT NULL GROUP BY day_type, {DETOUR}"""),
    "stress_share_table": _share_table(),
    "trip_length_stats": with_(LENGTH_TRIPS, f"""
SELECT grain, vehicle_type, propulsion_type, month, quart_year, {STATS_R} FROM (
  SELECT 'month' AS grain, vehicle_type, propulsion_type, month, CAST(NULL AS VARCHAR) AS quart_year, {STATS}
    FROM chosen GROUP BY vehicle_type, propulsion_type, month
  UNION ALL SELECT 'month_quarter', vehicle_type, propulsion_type, month, quart_year, {STATS}
    FROM chosen GROUP BY vehicle_type, propulsion_type, month, quart_year
  UNION ALL SELECT 'vehicle', vehicle_type, propulsion_type, NULL, NULL, {STATS}
    FROM chosen GROUP BY vehicle_type, propulsion_type)"""),
    "trip_length_by_vehicle": with_(LENGTH_TRIPS, f"""
SELECT vehicle_type, propulsion_type, {STATS_R} FROM (
  SELECT vehicle_type, propulsion_type, {STATS} FROM chosen GROUP BY vehicle_type, propulsion_type)"""),
    "geojson_export": with_(RC + "," + TRIPS, f"""
SELECT 'feature' AS type, c.trip_id, c.dist_calc, round(c.f_distance, 3) AS f_distance, round(c.safe_ratio, 3) AS dist_ratio,
  c.propulsion_type, {r("lon_o", 3)}, {r("lat_o", 3)}, {r("lon_d", 3)}, {r("lat_d", 3)}, CAST(c.flen AS DOUBLE) AS length
FROM clean c JOIN {BOTH_ENDS_ONCE} t ON t.k = c.k"""),
    "geojson_merge": with_(RC, """
SELECT band, propulsion_type, count(*) AS features, sum(dist_calc) AS dist_calc, CAST(2 * count(*) AS BIGINT) AS vertices,
  sum(CAST(flen AS DOUBLE)) AS length
FROM clean GROUP BY band, propulsion_type"""),
    "banded_trip_table": with_(WAYS + "," + TRIPS, """
SELECT propulsion_type, count(*) AS trips, sum(dist_calc) AS metres FROM trips
WHERE band = '321_384' AND vehicle_type = 'bicycle' AND matching_error < 70 GROUP BY propulsion_type"""),
}
