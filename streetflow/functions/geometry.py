"""Planar geometry on ``array<struct<x,y>>`` lines, as Catalyst expressions.

Everything here is JVM-side. Lines are arrays of points in metres; a *segment* is the flat struct
``(seg, x0, y0, x1, y1, x2, y2)`` where (x2, y2) is the vertex after the segment (NULL at the end of
the line) so that the bevel of a buffered corner travels with the segment before it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOUCH_EPS = 1e-9
SEGMENT = ("x0", "y0", "x1", "y1", "x2", "y2")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body mentions it."""
    return F.transform(F.array(value), body)[0]


def point(x, y) -> Column:
    return F.struct(F.col(x).alias("x") if isinstance(x, str) else x.cast("double").alias("x"),
                    F.col(y).alias("y") if isinstance(y, str) else y.cast("double").alias("y"))


def start_point(line: Column) -> Column:
    return F.get(line, F.lit(0))


def end_point(line: Column) -> Column:
    return F.get(line, F.size(line) - 1)


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def drop_repeated(line: Column) -> Column:
    """Remove vertices equal to the one before, which carry no direction."""
    return F.filter(line, lambda p, i: (i == 0) | (p != F.get(line, i - 1)))


def straightened(line: Column) -> Column:
    """The line without repeated vertices and without those it runs straight through, which leave its buffer as it is."""

    def needed(g):
        def turns(p, i):
            before, after = F.get(g, i - 1), F.get(g, i + 1)
            ax, ay, bx, by = p["x"] - before["x"], p["y"] - before["y"], after["x"] - p["x"], after["y"] - p["y"]
            return F.coalesce((ax * by - ay * bx != 0) | (ax * bx + ay * by <= 0), F.lit(True))

        return F.when(F.size(g) < 3, g).otherwise(F.filter(g, turns))

    return let(drop_repeated(line), needed)


def segments(line: Column) -> Column:
    """array<segment> of a line, zero-length segments left out."""
    def split(g):
        heads = F.slice(g, F.lit(1), F.greatest(F.size(g) - 1, F.lit(0)))
        return F.transform(
            heads,
            lambda p, i: F.struct(
                i.cast("int").alias("seg"),
                p["x"].alias("x0"), p["y"].alias("y0"),
                F.get(g, i + 1)["x"].alias("x1"), F.get(g, i + 1)["y"].alias("y1"),
                F.get(g, i + 2)["x"].alias("x2"), F.get(g, i + 2)["y"].alias("y2"),
            ),
        )

    return let(drop_repeated(line), split)


def segment_length(s: Column) -> Column:
    return F.hypot(s["x1"] - s["x0"], s["y1"] - s["y0"])


def framed(s: Column) -> Column:
    """The segment with what buffer tests need, computed once before the join: unit direction (ux, uy),
    half length h, unit direction (vx, vy) of the next segment, and the outer side of the corner
    (1 left, -1 right, 0 no corner).
    """
    return F.struct(s["seg"].alias("seg"), *frame(s))


def frame(s: Column) -> list[Column]:
    """The fields of ``framed`` but the segment's place in its line."""
    n = segment_length(s)
    n2 = F.nullif(F.hypot(s["x2"] - s["x1"], s["y2"] - s["y1"]), F.lit(0.0))
    return [
        *[s[f].alias(f) for f in SEGMENT], ((s["x1"] - s["x0"]) / n).alias("ux"), ((s["y1"] - s["y0"]) / n).alias("uy"), (n / 2).alias("h"),
        ((s["x2"] - s["x1"]) / n2).alias("vx"), ((s["y2"] - s["y1"]) / n2).alias("vy"),
        F.coalesce(-F.signum(turn(s)), F.lit(0.0)).alias("side")]


def unframed(s: Column) -> Column:
    return F.struct(*[s[f].alias(f) for f in SEGMENT])


def line_length(line: Column) -> Column:
    parts = F.transform(
        F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0))),
        lambda p, i: distance(p, F.get(line, i + 1)),
    )
    return F.aggregate(parts, F.lit(0.0), lambda acc, d: acc + d)


def ring_area(ring: Column) -> Column:
    """Unsigned shoelace area; the ring may be open or closed."""
    terms = F.transform(
        ring,
        lambda p, i: p["x"] * F.coalesce(F.get(ring, i + 1), F.get(ring, F.lit(0)))["y"]
        - F.coalesce(F.get(ring, i + 1), F.get(ring, F.lit(0)))["x"] * p["y"],
    )
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)) / 2


def polygon_area(rings: Column) -> Column:
    """Outer ring minus holes."""
    outer = ring_area(F.get(rings, F.lit(0)))
    holes = F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))
    return outer - F.aggregate(holes, F.lit(0.0), lambda acc, r: acc + ring_area(r))


# ---------------------------------------------------------------- buffers (flat cap, bevel join)

def turn(s: Column) -> Column:
    """Cross product of the segment with the next one: > 0 left turn, NULL at the end of the line."""
    return (s["x1"] - s["x0"]) * (s["y2"] - s["y1"]) - (s["y1"] - s["y0"]) * (s["x2"] - s["x1"])


def segment_rectangle(s: Column, width: float) -> Column:
    """Corners of a framed segment's buffer."""
    ox, oy = -s["uy"] * width, s["ux"] * width
    return F.array(
        point(s["x0"] + ox, s["y0"] + oy), point(s["x1"] + ox, s["y1"] + oy),
        point(s["x1"] - ox, s["y1"] - oy), point(s["x0"] - ox, s["y0"] - oy),
    )


def segment_bevel(s: Column, width: float) -> Column:
    """Triangle filling the outer side of the corner after a framed segment; NULL without a corner."""
    w = s["side"] * width
    return F.when(
        s["side"] != 0,
        F.array(
            point(s["x1"], s["y1"]),
            point(s["x1"] - w * s["uy"], s["y1"] + w * s["ux"]),
            point(s["x1"] - w * s["vy"], s["y1"] + w * s["vx"]),
        ),
    )


def buffer_pieces(line: Column, width: float) -> Column:
    """The buffer of a line as convex pieces: a rectangle per segment and a bevel per corner."""

    def both(segs):
        return F.concat(
            F.transform(segs, lambda s: segment_rectangle(s, width)),
            F.filter(F.transform(segs, lambda s: segment_bevel(s, width)), lambda p: p.isNotNull()))

    return let(F.transform(segments(line), framed), both)


def _pieces_sql(s: str, w: float) -> str:
    rect = (f"array(struct({s}.x0 - {w} * {s}.uy AS x, {s}.y0 + {w} * {s}.ux AS y), "
            f"struct({s}.x1 - {w} * {s}.uy AS x, {s}.y1 + {w} * {s}.ux AS y), "
            f"struct({s}.x1 + {w} * {s}.uy AS x, {s}.y1 - {w} * {s}.ux AS y), "
            f"struct({s}.x0 + {w} * {s}.uy AS x, {s}.y0 - {w} * {s}.ux AS y))")
    if not w:
        return f"array({rect})"
    k = f"{s}.side * {w}"
    bevel = (f"array(struct({s}.x1 AS x, {s}.y1 AS y), "
             f"struct({s}.x1 - {k} * {s}.uy AS x, {s}.y1 + {k} * {s}.ux AS y), "
             f"struct({s}.x1 - {k} * {s}.vy AS x, {s}.y1 + {k} * {s}.vx AS y))")
    return f"CASE WHEN {s}.side = 0 THEN array({rect}) ELSE array({rect}, {bevel}) END"


def _convex_touches_sql(p: str, q: str) -> str:
    """Separating-axis test for two convex rings given as point arrays."""

    def edges(r):
        return (f"transform({r}, (v, i) -> struct(coalesce(get({r}, i + 1), get({r}, 0)).x - v.x AS x, "
                f"coalesce(get({r}, i + 1), get({r}, 0)).y - v.y AS y))")

    def gap(r, t):
        return (f"array_max(transform({r}, v -> v.y * e.x - v.x * e.y)) < "
                f"array_min(transform({t}, v -> v.y * e.x - v.x * e.y)) - {TOUCH_EPS!r}D * hypot(e.x, e.y)")

    return f"NOT exists(concat({edges(p)}, {edges(q)}), e -> {gap(p, q)} OR {gap(q, p)})"


def convex_touches(p: str, q: str) -> Column:
    """Do the convex rings in columns ``p`` and ``q`` share at least a point?"""
    return F.expr(_convex_touches_sql(p, q))


def buffer_segment_touches(a: str, b: str, wa: float, wb: float) -> Column:
    return F.expr(buffer_segment_touches_sql(a, b, wa, wb))


def buffer_segment_touches_sql(a: str, b: str, wa: float, wb: float) -> str:
    """Do the buffers of the framed segments in columns ``a`` and ``b`` share at least a point?

    Rectangles are tested on their four separating axes. Only when that fails and a corner exists
    does the interpreted polygon test for the bevels run. As SQL text, for the driver's sake: one
    parse instead of hundreds of calls.
    """
    dx, dy = f"({b}.x0 + {b}.x1 - {a}.x0 - {a}.x1) / 2", f"({b}.y0 + {b}.y1 - {a}.y0 - {a}.y1) / 2"
    cos = f"abs({a}.ux * {b}.ux + {a}.uy * {b}.uy)"
    sin = f"abs({a}.ux * {b}.uy - {a}.uy * {b}.ux)"
    eps = f"{TOUCH_EPS!r}D"
    tests = []
    for s, h, w, oh, ow in ((a, f"{a}.h", wa, f"{b}.h", wb), (b, f"{b}.h", wb, f"{a}.h", wa)):
        tests += [
            f"abs({dx} * {s}.ux + {dy} * {s}.uy) <= {h} + {oh} * {cos} + {ow}D * {sin} + {eps}",
            f"abs({dx} * {s}.uy - {dy} * {s}.ux) <= {w}D + {oh} * {sin} + {ow}D * {cos} + {eps}",
        ]
    corner = f"{b}.side <> 0" + (f" OR {a}.side <> 0" if wa else "")
    # A bevel reaches no further from its segment than the width.
    near = f"hypot({dx}, {dy}) <= {a}.h + {b}.h + {wa + wb}D"
    bevels = (f"exists({_pieces_sql(a, wa)}, p -> exists({_pieces_sql(b, wb)}, q -> {_convex_touches_sql('p', 'q')}))")
    return f"({' AND '.join(tests)}) OR (({corner}) AND {near} AND {bevels})"


# ---------------------------------------------------------------- linear referencing

def cumulative_lengths(line: Column) -> Column:
    """array<double>: distance from the start to each vertex."""
    zero = F.array(F.lit(0.0))
    steps = F.transform(
        F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0))),
        lambda p, i: distance(p, F.get(line, i + 1)),
    )
    return F.aggregate(steps, zero, lambda acc, d: F.concat(acc, F.array(F.element_at(acc, -1) + d)))


def locate(line: Column, cum: Column, px: Column, py: Column) -> Column:
    """struct(dist, x, y, fraction) of the point on ``line`` nearest to (px, py); the first wins ties."""

    def nearest(p, i):
        q = F.get(line, i + 1)
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        len2 = dx * dx + dy * dy
        t = F.when(len2 > 0, F.least(F.lit(1.0), F.greatest(
            F.lit(0.0), ((px - p["x"]) * dx + (py - p["y"]) * dy) / len2))).otherwise(F.lit(0.0))
        x, y = p["x"] + t * dx, p["y"] + t * dy
        return F.struct(
            F.hypot(px - x, py - y).alias("dist"), i.cast("int").alias("i"),
            x.alias("x"), y.alias("y"),
            (F.get(cum, i) + t * (F.get(cum, i + 1) - F.get(cum, i))).alias("at"),
        )

    best = F.array_min(F.transform(F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0))), nearest))
    return let(best, lambda b: F.struct(
        b["dist"].alias("dist"), b["x"].alias("x"), b["y"].alias("y"),
        F.coalesce(F.try_divide(b["at"], F.element_at(cum, -1)), F.lit(0.0)).alias("fraction"),
    ))


def closest_point(line: Column, px: Column, py: Column) -> Column:
    at = locate(line, cumulative_lengths(line), px, py)
    return F.struct(at["x"].alias("x"), at["y"].alias("y"))


def line_locate_point(line: Column, px: Column, py: Column) -> Column:
    return locate(line, cumulative_lengths(line), px, py)["fraction"]


def angle_between(p1: Column, p2: Column, p3: Column, p4: Column) -> Column:
    """Clockwise angle from p1->p2 to p3->p4 in [0, 2*pi); NULL when either has no length."""
    ax, ay, bx, by = p2["x"] - p1["x"], p2["y"] - p1["y"], p4["x"] - p3["x"], p4["y"] - p3["y"]
    wrapped = let(F.atan2(bx, by) - F.atan2(ax, ay), lambda v: F.when(v < 0, v + 2 * F.pi()).otherwise(v))
    return F.when(((ax != 0) | (ay != 0)) & ((bx != 0) | (by != 0)), wrapped)


# ---------------------------------------------------------------- lines against polygons (all rings)

def ring_edges(rings: Column) -> Column:
    """array<struct(x0,y0,x1,y1)> over every ring, closed if the input is open."""

    def one(r):
        closed = F.when(start_point(r) == end_point(r), r).otherwise(F.concat(r, F.array(start_point(r))))
        return F.transform(
            F.slice(closed, F.lit(1), F.greatest(F.size(closed) - 1, F.lit(0))),
            lambda p, i: F.struct(
                p["x"].alias("x0"), p["y"].alias("y0"),
                F.get(closed, i + 1)["x"].alias("x1"), F.get(closed, i + 1)["y"].alias("y1"),
            ),
        )

    return F.flatten(F.transform(rings, one))


def inside_or_on(edges: Column, px: Column, py: Column, eps: float = 1e-9) -> Column:
    """Even-odd test over all edges; points on the boundary count as inside."""
    crossings = F.size(F.filter(
        edges,
        lambda e: ((e["y0"] > py) != (e["y1"] > py))
        & (px < e["x0"] + (py - e["y0"]) * (e["x1"] - e["x0"]) / F.nullif(e["y1"] - e["y0"], F.lit(0.0))),
    ))

    def on(e):
        dx, dy = e["x1"] - e["x0"], e["y1"] - e["y0"]
        n = F.hypot(dx, dy)
        along = ((px - e["x0"]) * dx + (py - e["y0"]) * dy) / F.nullif(n, F.lit(0.0))
        off = F.abs((px - e["x0"]) * dy - (py - e["y0"]) * dx) / F.nullif(n, F.lit(0.0))
        return (off <= eps) & (along >= -eps) & (along <= n + eps)

    return (crossings % 2 == 1) | F.exists(edges, lambda e: F.coalesce(on(e), F.lit(False)))


def cut_middles(s: Column, lo: Column, hi: Column, edges: Column) -> Column:
    """Middles, as shares of the segment's length, of the pieces between ``lo`` and ``hi`` that edges cut it into."""
    dx, dy = s["x1"] - s["x0"], s["y1"] - s["y0"]

    def at(e):
        ex, ey = e["x1"] - e["x0"], e["y1"] - e["y0"]
        den = dx * ey - dy * ex
        t = ((e["x0"] - s["x0"]) * ey - (e["y0"] - s["y0"]) * ex) / F.nullif(den, F.lit(0.0))
        u = ((e["x0"] - s["x0"]) * dy - (e["y0"] - s["y0"]) * dx) / F.nullif(den, F.lit(0.0))
        n2 = dx * dx + dy * dy
        ends = [((e[f"x{k}"] - s["x0"]) * dx + (e[f"y{k}"] - s["y0"]) * dy) / n2 for k in (0, 1)]
        return F.when(den != 0, F.array(F.when((u >= 0) & (u <= 1), t))).otherwise(F.array(*ends))

    met = F.filter(F.flatten(F.transform(edges, at)), lambda t: t.isNotNull() & (t > lo) & (t < hi))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(lo), met, F.array(hi))))
    return F.transform(F.slice(cuts, F.lit(1), F.size(cuts) - 1), lambda t, i: (t + F.get(cuts, i + 1)) / 2)


def line_within(line: Column, edges: Column, eps: float = 1e-9) -> Column:
    """No point of the line outside the polygon and some of it strictly inside.

    Each segment is cut where it meets the boundary; the line is within when every cut's midpoint is
    inside or on the boundary and at least one is off the boundary. ``lines_within`` does this by cells.
    """
    mids = F.flatten(F.transform(segments(line), lambda s: F.transform(
        cut_middles(s, F.lit(0.0), F.lit(1.0), edges), lambda t: F.struct(
            (s["x0"] + t * (s["x1"] - s["x0"])).alias("x"), (s["y0"] + t * (s["y1"] - s["y0"])).alias("y")))))
    return F.forall(mids, lambda m: inside_or_on(edges, m["x"], m["y"], eps)) & F.exists(
        mids, lambda m: inside_or_on(edges, m["x"], m["y"], eps) & ~on_boundary(edges, m["x"], m["y"], eps))


def on_boundary(edges: Column, px: Column, py: Column, eps: float) -> Column:
    def on(e):
        dx, dy = e["x1"] - e["x0"], e["y1"] - e["y0"]
        n = F.hypot(dx, dy)
        along = ((px - e["x0"]) * dx + (py - e["y0"]) * dy) / F.nullif(n, F.lit(0.0))
        off = F.abs((px - e["x0"]) * dy - (py - e["y0"]) * dx) / F.nullif(n, F.lit(0.0))
        return F.coalesce((off <= eps) & (along >= -eps) & (along <= n + eps), F.lit(False))

    return F.exists(edges, on)
