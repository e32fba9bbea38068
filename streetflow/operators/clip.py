"""Trip lines clipped by street buffers, as two-vertex segments in trip direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetflow.functions import geometry as G
from streetflow.operators import grid
from streetflow.operators.storage import BROADCAST_BYTES
from streetflow.schema import BUFFER_M

JOIN_EPS = 1e-9


def _between(v0: Column, v1: Column, lo, hi) -> tuple[Column, Column]:
    """Parameters t in [-inf, inf] for which v0 + t (v1 - v0) lies in [lo, hi]; empty when t_in > t_out."""
    flat = F.abs(v1 - v0) <= JOIN_EPS
    ok = (v0 >= lo - JOIN_EPS) & (v0 <= hi + JOIN_EPS)
    ta, tb = F.try_divide(lo - v0, v1 - v0), F.try_divide(hi - v0, v1 - v0)
    inf = F.lit(float("inf"))
    return (
        F.when(flat, F.when(ok, -inf).otherwise(inf)).otherwise(F.least(ta, tb)),
        F.when(flat, F.when(ok, inf).otherwise(-inf)).otherwise(F.greatest(ta, tb)),
    )


def _interval(bounds: list[tuple[Column, Column]]) -> Column:
    """struct(t0, t1) inside [0, 1], NULL when empty or a single point."""
    t0 = F.greatest(F.lit(0.0), *[b[0] for b in bounds])
    t1 = F.least(F.lit(1.0), *[b[1] for b in bounds])
    return F.when(t1 > t0, F.struct(t0.alias("t0"), t1.alias("t1")))


def rectangle_interval(a: Column, b: Column, width: float) -> Column:
    """Part of segment ``a`` inside the flat-cap rectangle of the framed segment ``b``."""
    n, ux, uy = 2 * b["h"], b["ux"], b["uy"]

    def along(k):
        return (a[f"x{k}"] - b["x0"]) * ux + (a[f"y{k}"] - b["y0"]) * uy

    def off(k):
        return (a[f"y{k}"] - b["y0"]) * ux - (a[f"x{k}"] - b["x0"]) * uy

    return _interval([_between(along(0), along(1), F.lit(0.0), n),
                      _between(off(0), off(1), F.lit(-width), F.lit(width))])


def bevel_interval(a: Column, b: Column, width: float) -> Column:
    """Part of segment ``a`` inside the bevel after the framed segment ``b``; NULL when there is no corner."""

    def clip(tri):
        p = [F.get(tri, F.lit(i)) for i in range(3)]
        left = F.signum((p[1]["x"] - p[0]["x"]) * (p[2]["y"] - p[0]["y"])
                        - (p[1]["y"] - p[0]["y"]) * (p[2]["x"] - p[0]["x"]))

        def sides(i):
            q, r = p[i], p[(i + 1) % 3]
            return F.struct(*[
                (left * ((r["x"] - q["x"]) * (a[f"y{k}"] - q["y"])
                         - (r["y"] - q["y"]) * (a[f"x{k}"] - q["x"]))).alias(f"v{k}") for k in (0, 1)])

        inside = F.transform(F.array(*[sides(i) for i in range(3)]), _half_plane)
        return F.struct(F.array_max(F.transform(inside, lambda v: v["t0"])).alias("t0"),
                        F.array_min(F.transform(inside, lambda v: v["t1"])).alias("t1"))

    return F.when(b["side"] != 0, G.let(
        G.let(G.segment_bevel(b, width), clip), lambda v: F.when(v["t1"] > v["t0"], v)))


def _half_plane(v: Column) -> Column:
    """Parameters in [0, 1] at which v0 + t (v1 - v0) is not negative."""
    cross = F.try_divide(v["v0"], v["v0"] - v["v1"])
    return F.struct(
        F.when(v["v0"] >= 0, 0.0).when(v["v1"] >= 0, cross).otherwise(1.0).alias("t0"),
        F.when(v["v1"] >= 0, 1.0).when(v["v0"] >= 0, cross).otherwise(0.0).alias("t1"))


def _merge(intervals: Column) -> Column:
    """Union of (t0, t1) intervals."""

    def step(acc, nxt):
        last = F.element_at(acc, -1)
        joined = F.struct(last["t0"].alias("t0"), F.greatest(last["t1"], nxt["t1"]).alias("t1"))
        head = F.slice(acc, F.lit(1), F.size(acc) - 1)
        return F.when(nxt["t0"] <= last["t1"] + JOIN_EPS, F.concat(head, F.array(joined))).otherwise(
            F.concat(acc, F.array(nxt)))

    return G.let(F.array_sort(intervals), lambda ordered: F.aggregate(
        F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0))), F.slice(ordered, 1, 1), step))


def _nearest(pieces: Column, total: Column, px: Column, py: Column) -> Column:
    """struct(dist, x, y, fraction) of the point nearest to (px, py) on the street pieces; the first wins ties."""

    def on(s):
        dx, dy = s["x1"] - s["x0"], s["y1"] - s["y0"]
        len2 = dx * dx + dy * dy
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - s["x0"]) * dx + (py - s["y0"]) * dy) / len2))
        x, y = s["x0"] + t * dx, s["y0"] + t * dy
        return F.struct(F.hypot(px - x, py - y).alias("dist"), s["seg"].alias("seg"), x.alias("x"), y.alias("y"),
                        (s["from"] + t * F.sqrt(len2)).alias("at"))

    return G.let(F.array_min(F.transform(pieces, on)), lambda b: F.struct(
        b["dist"].alias("dist"), b["x"].alias("x"), b["y"].alias("y"),
        F.coalesce(F.try_divide(b["at"], total), F.lit(0.0)).alias("fraction")))


def clip_to_buffers(trips: DataFrame, ways: DataFrame, trip_columns: list[str], way_columns: list[str],
                    size: float = grid.CELL_M, max_broadcast: int = BROADCAST_BYTES,
                    share: int = grid.HOT_SHARE) -> DataFrame:
    """One row per maximal piece of a trip segment inside one street's buffer.

    Result: ``trip_columns``, ``way_columns``, ``way_key`` (identity of the street row), ``s0``/``s1``
    (piece ends, trip direction) and ``at0``/``at1``, each end's nearest street point with its
    fraction along the street. A piece's end lies within the buffer, so the street segment nearest
    to it is among those the trip segment was joined with: a joined row carries that segment, where it
    begins along the street and the street's length, and never the whole line.
    """
    streets = ways.select(
        *way_columns, F.xxhash64("osm_id", "geom").alias("way_key"),
        "geom", G.cumulative_lengths(G.drop_repeated(F.col("geom"))).alias("cum"))
    left = grid.segment_cells(trips, "geom", trip_columns, "a", 0.0, size, frame=True)
    right = grid.segment_cells(
        streets, "geom", [*way_columns, "way_key", "cum"], "b", BUFFER_M, size, frame=True).withColumns({
            "from": F.get("cum", F.col("b.seg")), "total": F.element_at("cum", -1)}).drop("cum")
    a, b = F.col("a"), F.col("b")
    near = G.buffer_segment_touches("a", "b", 0.0, BUFFER_M)
    pairs = grid.cell_join(left, right, near, "trip_id", max_broadcast, share)

    parts = F.array_compact(F.array(rectangle_interval(a, b, BUFFER_M), bevel_interval(a, b, BUFFER_M)))

    keys = [*trip_columns, "seg", "x0", "y0", "x1", "y1", "way_key", *way_columns, "total"]
    grouped = (
        pairs.select(
            *trip_columns, *way_columns, "way_key", "total", parts.alias("parts"),
            F.struct(*[b[c].alias(c) for c in ("seg", "x0", "y0", "x1", "y1")], F.col("from")).alias("piece"),
            *[a[c].alias(c) for c in ("seg", "x0", "y0", "x1", "y1")])
        .groupBy(*keys)
        .agg(F.flatten(F.collect_set("parts")).alias("parts"), F.collect_set("piece").alias("pieces"))
        .filter(F.size("parts") > 0))

    def at(t):
        return F.struct((F.col("x0") + t * (F.col("x1") - F.col("x0"))).alias("x"),
                        (F.col("y0") + t * (F.col("y1") - F.col("y0"))).alias("y"))

    def located(t):
        return G.let(at(t), lambda p: _nearest(F.col("pieces"), F.col("total"), p["x"], p["y"]))

    # Made before the explode: a filter on what follows stays above it and does not repeat the search for nearest points.
    ends = F.transform(_merge(F.col("parts")), lambda p: F.struct(
        at(p["t0"]).alias("s0"), at(p["t1"]).alias("s1"), located(p["t0"]).alias("at0"), located(p["t1"]).alias("at1")))
    return grouped.withColumn("part", F.explode(ends)).select(
        *trip_columns, *way_columns, "way_key", "part.s0", "part.s1", "part.at0", "part.at1")
