"""Polygons on the grid: which lines touch an area, which lie within one.

A polygon becomes one row per cell: the boundary edges near the cell and whether the cell's centre is
inside. A line segment is then tested against the few edges of its own cells, never against the whole
outline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streetflow.functions import geometry as G
from streetflow.operators import grid
from streetflow.operators.storage import BROADCAST_BYTES, cut_lineage

AREA_CELL_M = 500.0
#: Metres within which a point counts as on the boundary.
EPS = 1e-9


def area_cells(areas: DataFrame, key: str = "municipal", size: float = AREA_CELL_M) -> DataFrame:
    """(key, cx, cy, edges, centre_in) for every cell the polygon touches or covers."""
    edge = areas.select(key, F.explode(G.ring_edges(F.col("rings"))).alias("e"))
    lo = F.floor(F.least("e.y0", "e.y1") / size - 0.5).cast("long")
    hi = F.floor(F.greatest("e.y0", "e.y1") / size + 0.5).cast("long")
    mid_y = (F.col("cy") + 0.5) * size
    e = F.col("e")
    # Crossings of each cell row's centre line in order: centres between an odd one and the next are inside.
    row = W.partitionBy(key, "cy").orderBy("x")
    spans = (
        edge.withColumn("cy", F.explode(F.sequence(lo, hi)))
        .filter((e["y0"] > mid_y) != (e["y1"] > mid_y))
        .select(key, "cy", (e["x0"] + (mid_y - e["y0"]) * (e["x1"] - e["x0"]) / (e["y1"] - e["y0"])).alias("x"))
        .select(key, "cy", "x", F.lead("x").over(row).alias("to"), F.row_number().over(row).alias("n"))
        .filter(F.col("n") % 2 == 1))
    # the first centre right of x, and the last one left of, or at, the next crossing
    first, last = F.floor(F.col("x") / size - 0.5).cast("long") + 1, F.floor(F.col("to") / size - 0.5).cast("long")
    inner = (
        spans.filter(last >= first).select(key, F.explode(F.sequence(first, last)).alias("cx"), "cy")
        .groupBy(key, "cx", "cy").agg(F.lit(True).alias("centre_in")))
    border = (
        edge.withColumn("c", F.explode(grid.cells(e, 0.0, size)))
        .groupBy(key, F.col("c.cx").alias("cx"), F.col("c.cy").alias("cy"))
        .agg(F.collect_list("e").alias("edges"))
    )
    return border.join(inner, [key, "cx", "cy"], "full").select(
        key, "cx", "cy",
        F.coalesce("edges", F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")).alias("edges"),
        F.coalesce("centre_in", F.lit(False)).alias("centre_in"))


def _inside(px: Column, py: Column, size: float) -> Column:
    """Is a point of the cell inside, walking from the cell's centre: first along y, then along x."""
    cx, cy = (F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size

    def vertical(e):
        y = e["y0"] + (cx - e["x0"]) * (e["y1"] - e["y0"]) / F.nullif(e["x1"] - e["x0"], F.lit(0.0))
        return ((e["x0"] > cx) != (e["x1"] > cx)) & ((y > cy) != (y > py))

    def horizontal(e):
        x = e["x0"] + (py - e["y0"]) * (e["x1"] - e["x0"]) / F.nullif(e["y1"] - e["y0"], F.lit(0.0))
        return ((e["y0"] > py) != (e["y1"] > py)) & ((x > cx) != (x > px))

    flips = F.size(F.filter("edges", vertical)) + F.size(F.filter("edges", horizontal))
    return F.col("centre_in") != (flips % 2 == 1)


def _meets(s: Column, e: Column) -> Column:
    """Do two closed segments share a point?"""

    def side(p, q, r):
        return F.signum((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))

    a, b = (s["x0"], s["y0"]), (s["x1"], s["y1"])
    c, d = (e["x0"], e["y0"]), (e["x1"], e["y1"])
    boxes = (
        (F.least(a[0], b[0]) <= F.greatest(c[0], d[0])) & (F.least(c[0], d[0]) <= F.greatest(a[0], b[0]))
        & (F.least(a[1], b[1]) <= F.greatest(c[1], d[1])) & (F.least(c[1], d[1]) <= F.greatest(a[1], b[1])))
    return boxes & (side(a, b, c) * side(a, b, d) <= 0) & (side(c, d, a) * side(c, d, b) <= 0)


def lines_touching(lines: DataFrame, line: str, columns: list[str], areas: DataFrame, key: str = "municipal",
                   size: float = AREA_CELL_M, max_broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """``columns`` and ``key`` of the (line, area) pairs that intersect; one row per touching cell.

    Callers reduce with ``distinct``. Each segment is tested per cell: covered cells answer at once,
    border cells by edge crossings, or by the segment's start when that lies in the cell.
    """
    left = grid.segment_cells(lines, line, columns, "s", 0.0, size)
    s = F.col("s")
    starts_here = (F.floor(s["x0"] / size) == F.col("cx")) & (F.floor(s["y0"] / size) == F.col("cy"))
    covered = (F.size("edges") == 0) & F.col("centre_in")
    touches = covered | F.exists("edges", lambda e: _meets(s, e)) | (starts_here & _inside(s["x0"], s["y0"], size))
    return grid.cell_join(left, area_cells(areas, key, size), touches, columns[0], max_broadcast).select(*columns, key)


def _stretch(s: Column, c: Column, size: float) -> Column:
    """The part of a segment inside a cell, as shares of its length; empty if ``lo`` is not below ``hi``."""
    lo, hi = [F.lit(0.0)], [F.lit(1.0)]
    for k, n in (("x", c["cx"]), ("y", c["cy"])):
        start, step = s[f"{k}0"], s[f"{k}1"] - s[f"{k}0"]
        near, far = (n * size - start) / F.nullif(step, F.lit(0.0)), ((n + 1) * size - start) / F.nullif(step, F.lit(0.0))
        outside = (start < n * size) | (start > (n + 1) * size)
        lo.append(F.when(step != 0, F.least(near, far)).when(outside, 2.0).otherwise(0.0))
        hi.append(F.when(step != 0, F.greatest(near, far)).when(outside, -1.0).otherwise(1.0))
    return F.struct(F.greatest(*lo).alias("lo"), F.least(*hi).alias("hi"))


def lines_within(lines: DataFrame, line: str, areas: DataFrame, key: str = "municipal",
                 size: float = AREA_CELL_M, max_broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """Lines wholly inside an area, one row per (line, area): no point outside, some strictly inside.

    Each segment's stretch in a cell is cut where it meets the cell's own edges, and the middle of every cut is tested
    from the cell's centre. A line is within an area that holds every one of its stretches; no outline travels.
    """
    numbered = cut_lineage(lines.withColumn("_line", F.monotonically_increasing_id()), "lines")
    stretches = F.flatten(F.transform(G.segments(F.col(line)), lambda s: F.filter(
        F.transform(grid.cells(s, 0.0, size), lambda c: F.struct(
            s.alias("s"), c["cx"].alias("cx"), c["cy"].alias("cy"), _stretch(s, c, size).alias("t"))),
        lambda x: x["t"]["lo"] < x["t"]["hi"])))
    left = numbered.select("_line", stretches.alias("all")).select(
        "_line", F.size("all").alias("stretches"), F.explode("all").alias("one")).select("_line", "stretches", "one.*")
    s, lo, hi = F.col("s"), F.col("t.lo"), F.col("t.hi")
    dx, dy = s["x1"] - s["x0"], s["y1"] - s["y0"]
    tested = grid.cell_join(left, area_cells(areas, key, size), F.lit(True), "_line", max_broadcast).withColumn(
        "mids", G.cut_middles(s, lo, hi, F.col("edges")))

    def at(t):
        return s["x0"] + t * dx, s["y0"] + t * dy

    def on(t):
        return G.on_boundary(F.col("edges"), *at(t), EPS)

    verdict = tested.select(
        "_line", "stretches", key, F.forall("mids", lambda t: on(t) | _inside(*at(t), size)).alias("inside"),
        F.exists("mids", lambda t: ~on(t) & _inside(*at(t), size)).alias("strictly"))
    within = verdict.groupBy("_line", "stretches", key).agg(
        F.count_if("inside").alias("n"), F.bool_or("strictly").alias("strictly")).filter("n = stretches AND strictly")
    return numbered.join(within.select("_line", key), "_line").select(*lines.columns, key)
