"""Dissolved overlap of buffered trips and buffered streets.

The wanted number per (trip, street) is the area of (union of trip pieces) intersect (union of street
pieces). Area is additive over disjoint cells, so the job groups by (trip, street, cell), integrates
inside the cell, and sums. A group therefore never holds more than the distinct pieces of one street
and one trip inside one cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetflow.functions import geometry as G
from streetflow.functions import outlines, slabs
from streetflow.operators import grid
from streetflow.operators.storage import BROADCAST_BYTES, cut_lineage
from streetflow.schema import BUFFER_M

AREA_DIGITS = 6
MOMENT_SCALE = 1000.0

# Executors get the array code inside the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(slabs)
cloudpickle.register_pickle_by_value(outlines)


def _moments_udf(size: float, wa: float, wb: float):
    scale = MOMENT_SCALE

    @F.arrow_udf("struct<area:double,mx:bigint,my:bigint,mxx:bigint,mxy:bigint,myy:bigint>")
    def moments(a: pa.Array, b: pa.Array, cx: pa.Array, cy: pa.Array) -> pa.Array:
        m = slabs.overlap_moments(a, b, cx.to_numpy(zero_copy_only=False), cy.to_numpy(zero_copy_only=False), size, wa, wb)
        whole = np.rint(m[:, 1:] * scale).astype(np.int64)
        return pa.StructArray.from_arrays(
            [pa.array(m[:, 0]), *[pa.array(whole[:, k]) for k in range(5)]],
            ["area", "mx", "my", "mxx", "mxy", "myy"],
        )

    return moments


#: What a piece carries through the join; a trip's or street's place in its line does not matter here.
PIECE = (*G.SEGMENT, "ux", "uy", "h", "vx", "vy", "side")


def _straight_pieces(line: Column) -> Column:
    """array of framed segments of the straightened line."""
    return F.transform(G.segments(G.straightened(line)), lambda s: G.let(
        G.framed(s), lambda f: F.struct(*[f[c].alias(c) for c in PIECE])))


def _trip_cells(trips: DataFrame, size: float) -> DataFrame:
    """(band, trip_id, cx, cy, a) and the box around ``a``: the distinct pieces of each trip by cell.

    Rows of one trip come together while they are small. A trip of one straight piece is its own group in every cell;
    only the others are grouped by cell.
    """
    lines = F.flatten(F.transform(F.collect_set("geom"), _straight_pieces))
    whole = cut_lineage(trips.groupBy("band", "trip_id").agg(F.array_distinct(lines).alias("a")), "pieces")
    at = F.col("_c.cx").alias("cx"), F.col("_c.cy").alias("cy")
    # one box for all cells of a piece
    alone = grid.boxed(whole.filter(F.size("a") == 1), "a[0]", "a", BUFFER_M).withColumn(
        "_c", F.explode(grid.cells(F.col("a")[0], BUFFER_M, size)))
    each = whole.filter(F.size("a") > 1).select("band", "trip_id", F.explode("a").alias("s")).withColumn(
        "_c", F.explode(grid.cells(F.col("s"), BUFFER_M, size)))
    several = each.select("band", "trip_id", *at, "s").groupBy("band", "trip_id", "cx", "cy").agg(F.collect_list("s").alias("a"))
    return alone.select("band", "trip_id", *at, *[c for c in alone.columns if c not in ("band", "trip_id", "_c")]).unionByName(
        grid.boxed(several, "a", "a", BUFFER_M, several=True))


def _stripped(left: DataFrame) -> DataFrame:
    """Trips' rows as they are shuffled: the ends of their pieces, without directions and boxes, which follow from them."""
    return _each_piece(left.drop(*[c for c in left.columns if c.startswith("a_")]), G.unframed)


def _restored(left: DataFrame) -> DataFrame:
    return grid.boxed(_each_piece(left, lambda s: F.struct(*G.frame(s))), "a", "a", BUFFER_M, several=True)


def _each_piece(left: DataFrame, body) -> DataFrame:
    a = F.col("a")
    return left.withColumn("a", F.when(F.size(a) == 1, F.array(body(a[0]))).otherwise(F.transform(a, body)))


def _street_cells(ways: DataFrame, size: float) -> DataFrame:
    """(osm_id, cx, cy, b): the distinct pieces of each street by cell, with its name and class."""
    each = ways.select("osm_id", F.col("name").alias("hname"), F.col("lts").alias("stress_lev"),
                       F.explode(_straight_pieces(F.col("geom"))).alias("s"))
    placed = each.withColumn("_c", F.explode(grid.cells(F.col("s"), BUFFER_M, size)))
    piece = F.struct(*[F.col(f"s.{c}").alias(c) for c in PIECE], "hname", "stress_lev")
    return placed.groupBy("osm_id", F.col("_c.cx").alias("cx"), F.col("_c.cy").alias("cy")).agg(F.collect_set(piece).alias("b"))


def touching_pieces(trips: DataFrame, ways: DataFrame, size: float = grid.CELL_M,
                    max_broadcast: int = BROADCAST_BYTES, share: int = grid.HOT_SHARE) -> DataFrame:
    """(band, trip_id, osm_id, cx, cy) with the distinct touching pieces of each side.

    Both sides are grouped before they meet, so a joined row is a whole group and is not shuffled for it.
    """

    def touch(x: str, y: str) -> str:
        return G.buffer_segment_touches_sql(x, y, BUFFER_M, BUFFER_M)

    single = "size(a) = 1 AND size(b) = 1"
    met = f"CASE WHEN {single} THEN {touch('a[0]', 'b[0]')} ELSE exists(a, x -> exists(b, y -> {touch('x', 'y')})) END"
    left = _trip_cells(trips, size)
    right = grid.boxed(_street_cells(ways, size), "b", "b", BUFFER_M, several=True)
    joined = grid.cell_join(left, right, grid.boxes_meet("a", "b") & F.expr(met), "trip_id", max_broadcast, share,
                            _stripped, _restored)
    near = joined.withColumns({
        "a": F.expr(f"CASE WHEN {single} THEN a ELSE filter(a, x -> exists(b, y -> {touch('x', 'y')})) END"),
        "b": F.expr(f"CASE WHEN {single} THEN b ELSE filter(b, y -> exists(a, x -> {touch('x', 'y')})) END")})

    def plain(name: str) -> Column:
        c = F.col(name)
        several = F.transform(c, G.unframed)
        return F.when(F.size(c) == 1, F.array(G.unframed(c[0]))).otherwise(
            several if name == "a" else F.array_distinct(several))

    return near.select(
        "band", "trip_id", "osm_id", "cx", "cy", plain("a").alias("a"), plain("b").alias("b"),
        F.array_max("b.hname").alias("hname"), F.array_min("b.stress_lev").alias("stress_lev"))


def overlap(trips: DataFrame, ways: DataFrame, size: float = grid.CELL_M,
            max_broadcast: int = BROADCAST_BYTES, share: int = grid.HOT_SHARE, named: bool = True) -> DataFrame:
    """One row per touching (band, trip_id, osm_id): hname (if ``named``), stress_lev, seg_area, shape.

    ``shape`` is equal for two streets of a trip exactly when their overlap regions are equal; it
    stands in for the geometry wherever that is a grouping key. Areas are rounded to 1e-6 square
    metres so that thresholds do not depend on summation order.
    """
    pieces = touching_pieces(trips, ways, size, max_broadcast, share)
    measured = pieces.select(
        "band", "trip_id", "osm_id", "cx", "cy", "hname", "stress_lev",
        _moments_udf(size, BUFFER_M, BUFFER_M)("a", "b", "cx", "cy").alias("m"),
    )
    area = F.round("m.area", AREA_DIGITS)
    in_cell = F.when(area > 0, F.xxhash64("cx", "cy", F.rint(area * MOMENT_SCALE).cast("long"),
                                          "m.mx", "m.my", "m.mxx", "m.mxy", "m.myy"))
    name = ["hname"] if named else []
    return (
        measured.select("band", "trip_id", "osm_id", *name, "stress_lev", "m.area", in_cell.alias("in_cell"))
        .repartition("band", "trip_id")
        # cells first, in a hash table of numbers; what is left for the names is a row per trip and street
        .groupBy("band", "trip_id", "osm_id", *name, "stress_lev")
        .agg(F.sum("area").alias("area"), F.bit_xor("in_cell").alias("in_cell"))
        .groupBy("band", "trip_id", "osm_id")
        .agg(
            *[F.max(c).alias(c) for c in name], F.min("stress_lev").alias("stress_lev"),
            F.round(F.sum("area"), AREA_DIGITS).alias("seg_area"),
            F.coalesce(F.bit_xor("in_cell"), F.lit(0)).cast("long").alias("shape"),
        )
    )


# ---------------------------------------------------------------- the overlap as polygons

def _trapezoid_udf(size: float, wa: float, wb: float):
    ring = "array<struct<x:double,y:double>>"

    @F.arrow_udf(f"array<{ring}>")
    def trapezoids(a: pa.Array, b: pa.Array, cx: pa.Array, cy: pa.Array) -> pa.Array:
        at = (c.to_numpy(zero_copy_only=False) for c in (cx, cy))
        return slabs.overlap_trapezoids(a, b, *at, size, wa, wb)

    return trapezoids


def overlap_parts(trips: DataFrame, ways: DataFrame, size: float = grid.CELL_M,
                  max_broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """The overlap geometry dumped to disjoint convex parts, one ring per row."""
    pieces = touching_pieces(trips, ways, size, max_broadcast)
    return pieces.select(
        "band", "trip_id", "osm_id", "stress_lev",
        F.explode(_trapezoid_udf(size, BUFFER_M, BUFFER_M)("a", "b", "cx", "cy")).alias("part"),
    )


EDGE = "struct<x0:bigint,y0:bigint,x1:bigint,y1:bigint>"
RINGS = "array<array<struct<x:double,y:double>>>"


def once(udf):
    """The UDF held where it stands: a filter on what it returns does not move below its arguments and begin it again there."""
    return udf.asNondeterministic()


def _edges_udf(size: float, wa: float, wb: float):
    @F.arrow_udf(f"array<{EDGE}>")
    def edges(a: pa.Array, b: pa.Array, cx: pa.Array, cy: pa.Array) -> pa.Array:
        at = (c.to_numpy(zero_copy_only=False) for c in (cx, cy))
        return slabs.overlap_edges(a, b, *at, size, wa, wb)

    return once(edges)


def _parts_udf():
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    kind = pa.list_(pa.struct([("rings", pa.list_(pa.list_(point))), ("area", pa.float64()), ("ring_m", pa.float64())]))

    @F.arrow_udf(f"array<struct<rings:{RINGS},area:double,ring_m:double>>")
    def parts(edges: pa.Array) -> pa.Array:
        return outlines.region_parts(edges, kind)

    return once(parts)


def overlap_regions(trips: DataFrame, ways: DataFrame, size: float = grid.CELL_M, max_broadcast: int = BROADCAST_BYTES,
                    share: int = grid.HOT_SHARE) -> DataFrame:
    """The overlap of each (band, trip_id, osm_id) as geometry: hname, stress_lev, parts (rings, area, ring_m), seg_area.

    Cells send the boundary of their overlap only, and a row gathers those of one trip and one street, which is no more
    than the geometry it returns. Parts are connected across cells, may have holes, and are apart where they touch in a
    point. Pairs whose buffers merely touch have no row. Rings are in millimetres and in a normal form, so two regions are
    equal exactly when their ``parts`` are.
    """
    pieces = touching_pieces(trips, ways, size, max_broadcast, share)
    bounded = pieces.select(
        "band", "trip_id", "osm_id", "hname", "stress_lev",
        _edges_udf(size, BUFFER_M, BUFFER_M)("a", "b", "cx", "cy").alias("edges"))
    gathered = bounded.filter(F.size("edges") > 0).groupBy("band", "trip_id", "osm_id").agg(
        F.max("hname").alias("hname"), F.min("stress_lev").alias("stress_lev"),
        F.flatten(F.collect_list("edges")).alias("edges"))
    found = gathered.select("band", "trip_id", "osm_id", "hname", "stress_lev", _parts_udf()("edges").alias("parts"))
    area = F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p["area"])
    return found.filter(F.size("parts") > 0).withColumn("seg_area", F.round(area, AREA_DIGITS))
