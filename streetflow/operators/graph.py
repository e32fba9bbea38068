"""Batch shortest paths on the street network, as joins and aggregates.

The network is split at junctions into edges, and edges that meet at a node of no other edge are merged
into one, so that only true junctions are searched. Every origin/destination pair is snapped to its
nearest edges and then searched by label correction: each step joins the frontier with the edges and
keeps the least distance per (pair, node) with the last edge taken. An ellipse bound keeps a search
local; a pair whose best route is not proven within its bound is searched again with a doubled one, so
no route is lost to the bound. Routes are traced back from the last edges by pointer jumping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streetflow.functions import geometry as G
from streetflow.operators import grid
from streetflow.operators.storage import (
    broadcast_if_small,
    cut_counted,
    cut_lineage,
    cut_summed,
    run_dir,
    write_counted,
)

MM = 1000
SNAP_M = 50.0
SLACK = 1.2
SLACK_M = 50.0
IMPROVED = 1e-9
HOPS = 2
#: The snapping pyramid: cells below one cell each way, and the most cells each way of its top, less one.
FAN, TOP = 4, 8
#: Metres of an edge whose vertices a route meets at a time.
BLOCK_M = 1000.0


def node_key(x: Column, y: Column) -> Column:
    """Exact 64-bit identity of a vertex: millimetres of x and y, 32 bits each.

    Farther out than 2147 km the query fails; no two vertices are ever taken for one. ``edges`` numbers its vertices
    instead, so a network may be of any width.
    """
    xi, yi = F.rint(x * MM).cast("long"), F.rint(y * MM).cast("long")
    far = (F.abs(xi) >= 2**31) | (F.abs(yi) >= 2**31)
    xi = F.when(far, F.raise_error(F.lit("vertex beyond 2147 km")).cast("long")).otherwise(xi)
    return F.shiftleft(xi, 32).bitwiseOR(yi.bitwiseAND(F.lit(0xFFFFFFFF)))


def _mm(p: Column) -> list[Column]:
    """Whole millimetres of a point, its identity as a vertex, as columns x and y."""
    return [F.rint(p[c] * MM).cast("long").alias(c) for c in "xy"]


def edges(ways: DataFrame) -> DataFrame:
    """(edge, u, v, len, line): street pieces between junctions, written once to fix their numbers.

    A junction is an end of a street or a vertex that occurs more than once. ``u`` and ``v`` are numbers of junctions,
    which are told apart by their whole millimetres, however far out they lie.
    """
    lines = ways.select(G.drop_repeated(F.col("geom")).alias("line")).filter(F.size("line") > 1).distinct()
    lines = lines.withColumn("way", F.xxhash64("line")).withColumn("cum", G.cumulative_lengths(F.col("line")))
    vertex = lines.select("way", F.size("line").alias("n"), "cum", F.posexplode("line").alias("i", "p")).select(
        "way", "i", F.get("cum", F.col("i")).alias("at"), *_mm(F.col("p")),
        ((F.col("i") == 0) | (F.col("i") == F.col("n") - 1)).alias("tip"))
    junction = vertex.groupBy("x", "y").agg(F.count("*").alias("uses"), F.max("tip").alias("tip")).filter(
        (F.col("uses") > 1) | F.col("tip"))
    numbered = cut_lineage(junction.select(F.monotonically_increasing_id().alias("node"), "x", "y"), "junctions")
    along = W.partitionBy("way").orderBy("i")
    split = vertex.join(numbered, ["x", "y"]).select(
        "way", "i", F.col("node").alias("u"), "at",
        F.lead("node").over(along).alias("v"), F.lead("i").over(along).alias("j"),
        F.lead("at").over(along).alias("to")).filter(F.col("v").isNotNull())
    cut = split.join(lines.select("way", "line"), "way").select(
        "u", "v", (F.col("to") - F.col("at")).alias("len"),
        F.slice("line", F.col("i") + 1, F.col("j") - F.col("i") + 1).alias("line"))
    return cut_lineage(cut.select((F.monotonically_increasing_id() + 1).alias("edge"), "*"), "edges")


def _feet(pairs: DataFrame) -> DataFrame:
    """(px, py, d, sx, sy, edge, at): the nearest of the segments ``s`` that each point is paired with."""
    s, px, py = F.col("s"), F.col("px"), F.col("py")
    dx, dy = s["x1"] - s["x0"], s["y1"] - s["y0"]
    n2 = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - s["x0"]) * dx + (py - s["y0"]) * dy) / n2))
    x, y = s["x0"] + F.col("t") * dx, s["y0"] + F.col("t") * dy
    # equally near points are told apart by where they lie, not by the numbers of their edges
    hit = F.struct(F.round(F.hypot(px - x, py - y), 6).alias("d"), F.round(x, 6).alias("sx"), F.round(y, 6).alias("sy"),
                   F.col("edge"), (F.col("from") + F.col("t") * F.sqrt(n2)).alias("at"))
    return pairs.withColumn("t", t).groupBy("px", "py").agg(F.min(hit).alias("h")).select("px", "py", "h.*")


def _box(size: float) -> tuple[Column, Column]:
    """Least and greatest distance of a point from its row's cell."""
    gaps, reaches = [], []
    for p, c in (("px", "cx"), ("py", "cy")):
        low, high = F.col(c) * size - F.col(p), F.col(p) - (F.col(c) + 1) * size
        gaps.append(F.greatest(low, high, F.lit(0.0)))
        reaches.append(F.greatest(-low, -high))
    return F.hypot(*gaps), F.hypot(*reaches)


def _descend(points: DataFrame, occupied: DataFrame, size: float, limit: float | None) -> DataFrame:
    """(px, py, cx, cy): for each point the cells of ``size`` that can hold its nearest street, none farther than ``limit``.

    The cells with streets are the finest level of a pyramid, each cell above covers ``FAN`` by ``FAN`` below. From the
    few cells of the top a point goes down into those only that are not farther off than another one's far corner,
    for every cell holds a street somewhere. How far off a point lies does not change how many it meets.
    """
    reach = occupied.agg(*[(F.max(c) - F.min(c) + 1).alias(c) for c in ("cx", "cy")]).first()
    levels = [occupied]
    while max(reach["cx"], reach["cy"]) > TOP * FAN ** (len(levels) - 1):
        levels.append(levels[-1].select(*[F.floor(F.col(c) / FAN).cast("long").alias(c) for c in ("cx", "cy")]).distinct())
    # the top spans at most TOP + 1 cells each way
    top = [F.struct(F.lit(r["cx"]).alias("cx"), F.lit(r["cy"]).alias("cy")) for r in levels[-1].collect()]
    at = points.select("px", "py", F.inline(F.array(*top)))
    for k in range(len(levels) - 1, -1, -1):
        near, far = _box(size * FAN**k)
        bounded = at.withColumn("near", near).withColumn("most", F.min(far).over(W.partitionBy("px", "py")))
        at = bounded.filter((F.col("near") <= F.col("most")) & (F.col("near") <= F.lit(float("inf") if limit is None else limit))).select(
            "px", "py", "cx", "cy")
        if k:
            below = levels[k - 1].select(*[F.floor(F.col(c) / FAN).cast("long").alias(f"u{c}") for c in ("cx", "cy")], "cx", "cy")
            at = at.withColumnsRenamed({"cx": "ucx", "cy": "ucy"}).join(below, ["ucx", "ucy"]).select("px", "py", "cx", "cy")
    return at


def nearest_edge(points: DataFrame, network: DataFrame, radius: float = SNAP_M,
                 limit: float | None = None) -> DataFrame:
    """(px, py, edge, at, sx, sy): the nearest point of the network for each distinct point.

    Looks one cell around with cells of the radius' size, where a hit within the radius is the nearest. The rest go
    down a pyramid of the cells with streets and meet the segments of the few cells left, up to ``limit`` metres
    (default: however far). Points farther off, and all of them if there is no edge, come with NULLs. If ``network`` has
    a column ``from``, its lines begin there along their edge.
    """
    names = ["edge", "at", "sx", "sy"]

    def nowhere(some):
        return some.select("px", "py", *[F.lit(None).cast(t).alias(c) for c, t in zip(names, ("long", "double", "double", "double"))])

    if network.isEmpty():
        return nowhere(points)
    every = cut_lineage(points.select("px", "py").distinct(), "points")
    around = F.sequence(F.lit(-1), F.lit(1))
    looking = (
        every.withColumn("ox", F.explode(around)).withColumn("oy", F.explode(around))
        .select("px", "py", (F.floor(F.col("px") / radius) + F.col("ox")).cast("long").alias("cx"),
                (F.floor(F.col("py") / radius) + F.col("oy")).cast("long").alias("cy")))
    begin = F.col("from") if "from" in network.columns else F.lit(0.0)
    pieces = grid.segment_cells(
        network.select("edge", "line", begin.alias("begin"), G.cumulative_lengths(F.col("line")).alias("cum")),
        "line", ["edge", "begin", "cum"], "s", 0.0, radius
    ).select("cx", "cy", "edge", "s", (F.col("begin") + F.get("cum", F.col("s.seg"))).alias("from"))
    pieces, _ = broadcast_if_small(pieces)
    first = cut_lineage(_feet(looking.join(pieces, ["cx", "cy"])).filter(
        F.col("d") <= (radius if limit is None else min(radius, limit))).select("px", "py", *names), "snap")
    left, remaining = cut_counted(every.join(first, ["px", "py"], "left_anti"), "unsnapped")
    if not remaining:
        return first
    if limit is not None and limit <= radius:
        return first.unionByName(nowhere(left))
    occupied = cut_lineage(pieces.select("cx", "cy").distinct(), "cells")
    feet = _feet(_descend(left, occupied, radius, limit).join(pieces, ["cx", "cy"])).filter(
        F.col("d") <= F.lit(float("inf") if limit is None else limit))
    second = cut_lineage(left.join(feet.select("px", "py", *names), ["px", "py"], "left"), "snap")
    return first.unionByName(second)


def components(network: DataFrame) -> DataFrame:
    """(node, component): alternating large-star / small-star contraction (Kiveris et al. 2014).

    The number of rounds grows with the logarithm of the component size, not with its diameter. A
    node of many links is reduced by map-side minima before any shuffle.
    """
    link = cut_lineage(
        network.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
        .filter("a != b").distinct(), "links")
    last = None
    while True:
        both = link.unionByName(link.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut_lineage(large.filter("a != b").distinct(), "links")
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            floor.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        link, state = cut_summed(small, "links")
        if state == last:
            break
        last = state
    nodes = network.select("u").union(network.select("v")).distinct().withColumnRenamed("u", "node")
    return nodes.join(link, F.col("node") == F.col("a"), "left").select(
        "node", F.coalesce("b", "node").alias("component"))


def chained(network: DataFrame, belongs: DataFrame) -> DataFrame:
    """(edge, from, u, v, len, line): the edges of ``network`` turned along the chains they form and numbered by them.

    Edges belong to one chain where exactly two meet; ``edge`` is one of the chain's edges and ``from`` where the row
    begins along it, so a row is never longer than an edge. ``belongs``: (node, component). Every edge has a walk in both directions; where a walk arrives at a node between two
    edges it goes on with the other one. Pointer jumping over the walks gives each edge its chain, place and direction
    in as many rounds as the longest chain has binary digits. Components that are a ring stay as they are.
    """
    degree = network.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    nodes = cut_lineage(degree.join(belongs, "node"), "degrees")
    rings, _ = broadcast_if_small(nodes.groupBy("component").agg(F.bool_and(F.col("n") == 2).alias("ring")).filter("ring").select("component"))
    between = nodes.filter("n = 2").join(rings, "component", "left_anti").select("node")
    walks = network.select("len", F.explode(F.array(
        F.struct(F.col("edge").alias("walk"), F.col("u").alias("tail"), F.col("v").alias("head")),
        F.struct((-F.col("edge")).alias("walk"), F.col("v").alias("tail"), F.col("u").alias("head")))).alias("w")).select("len", "w.*")
    onward = walks.join(between, F.col("head") == F.col("node"), "left_semi").alias("w").join(
        walks.alias("n"), (F.col("w.head") == F.col("n.tail")) & (F.col("n.walk") != -F.col("w.walk"))).select(
        F.col("w.walk").alias("of"), F.col("n.walk").alias("to"))
    state, open_ = cut_counted(walks.join(onward, F.col("walk") == F.col("of"), "left").select(
        "walk", F.col("walk").alias("last"), "to", F.col("len").alias("after")), "walks")
    while open_:
        ahead = state.select(F.col("walk").alias("of"), F.col("last").alias("l"), F.col("to").alias("t"), F.col("after").alias("more"))
        state, open_ = _jumped(state.join(ahead, F.col("to") == F.col("of"), "left").select(
            "walk", F.coalesce("l", "last").alias("last"), F.col("t").alias("to"),
            (F.col("after") + F.coalesce("more", F.lit(0.0))).alias("after")))
    side = state.select(F.abs("walk").alias("edge"), (F.col("walk") > 0).alias("plus"), F.abs("last").alias("last"), "after")
    both = side.groupBy("edge").agg(*[F.max(F.when(F.col("plus") == plus, F.col(c))).alias(f"{c}_{plus}")
                                      for plus in (True, False) for c in ("last", "after")])
    chain = F.least("last_True", "last_False")
    along = F.col("last_False") == chain  # a walk back ends at the chain's first edge
    return cut_lineage(network.join(both, "edge").select(
        chain.alias("edge"), "len", (F.when(along, F.col("after_False")).otherwise(F.col("after_True")) - F.col("len")).alias("from"),
        F.when(along, F.col("u")).otherwise(F.col("v")).alias("u"), F.when(along, F.col("v")).otherwise(F.col("u")).alias("v"),
        F.when(along, F.col("line")).otherwise(F.reverse("line")).alias("line")), "chained")


def chains(parts: DataFrame) -> DataFrame:
    """(edge, u, v, len, ux, uy, vx, vy) of each chain, with the places of its ends but without its line, which may run
    through the whole network.
    """
    begin, end = (F.struct("from", node, *_mm(p)) for node, p in (("u", G.start_point(F.col("line"))), ("v", G.end_point(F.col("line")))))
    ends = parts.groupBy("edge").agg(F.min(begin).alias("b"), F.max(end).alias("e"), F.sum("len").alias("len"))
    return cut_lineage(ends.select("edge", "b.u", "e.v", "len", *[
        (F.col(f"{s}.{c}") / MM).alias(f"{node}{c}") for s, node in (("b", "u"), ("e", "v")) for c in "xy"]), "chains")


def contract(network: DataFrame, belongs: DataFrame) -> DataFrame:
    """``chains`` with their whole lines."""
    part = F.struct("from", "u", "v", "line")
    merged = chained(network, belongs).groupBy("edge").agg(F.sum("len").alias("len"), F.array_sort(F.collect_list(part)).alias("parts"))
    line = G.drop_repeated(F.flatten(F.transform("parts", lambda p: p["line"])))
    return cut_lineage(merged.select(
        "edge", F.col("parts")[0]["u"].alias("u"), F.element_at("parts", -1)["v"].alias("v"), "len", line.alias("line")), "contracted")


def _jumped(state: DataFrame) -> tuple[DataFrame, int]:
    """The written state, and how many walks have not ended yet."""
    path, seen = run_dir(state.sparkSession, "walks"), Observation()
    state.observe(seen, F.count("to").alias("n")).write.parquet(path)
    return state.sparkSession.read.schema(state.schema).parquet(path), seen.get["n"]


def _steps(network: DataFrame) -> DataFrame:
    """Both directions of every edge, with the place of the next node; the sign of ``step`` is the direction."""
    def way(node, other, step):
        return network.select(F.col(node).alias("node"), F.col(other).alias("next"), "len", step.alias("step"),
                              F.col(f"{other}x").alias("x"), F.col(f"{other}y").alias("y"))

    return way("u", "v", F.col("edge")).unionByName(way("v", "u", -F.col("edge")))


def _ahead(node: str) -> Column:
    """What is left to the destination from the node placed at ``node``x, ``node``y, as the crow flies."""
    return F.hypot(F.col(f"{node}x") - F.col("dx"), F.col(f"{node}y") - F.col("dy"))


def search(pairs: DataFrame, network: DataFrame) -> DataFrame:
    """(pair, f_distance, path, final) of each pair; every pair must lie within one component.

    ``pairs``: pair, o_edge, o_at, ou, ov, o_len and d_edge, d_at, du, dv, d_len, dx, dy (snapped
    destination), ``straight`` and oux, ouy, ovx, ovy, where ou and ov lie. ``path`` lists the steps from the origin's edge on and ``final`` is the step along
    the destination's edge. A route within one edge has that step as its path and no final one.
    """
    steps, _ = broadcast_if_small(_steps(network))
    open_pairs = pairs.withColumn("bound", F.col("straight") * SLACK + SLACK_M)
    solved = near = None
    while True:
        labels = _explore(open_pairs, steps)
        tips = F.array(
            F.struct(F.col("du").alias("node"), F.col("d_at").alias("rest"), F.col("d_edge").alias("final")),
            F.struct(F.col("dv").alias("node"), (F.col("d_len") - F.col("d_at")).alias("rest"), (-F.col("d_edge")).alias("final")))
        goal = open_pairs.select("pair", F.explode(tips).alias("t")).select("pair", "t.*")
        through = labels.join(goal, ["pair", "node"]).select(
            "pair", (F.col("dist") + F.col("rest")).alias("f_distance"), "final", "node")
        direct = open_pairs.filter(F.col("o_edge") == F.col("d_edge")).select(
            "pair", F.abs(F.col("o_at") - F.col("d_at")).alias("f_distance"),
            F.lit(None).cast("long").alias("final"), F.lit(None).cast("long").alias("node"))
        best = through.unionByName(direct).groupBy("pair").agg(
            F.min(F.struct("f_distance", "final", "node")).alias("m")).select("pair", "m.*")
        proven = cut_lineage(
            open_pairs.join(best, "pair").filter(F.col("f_distance") <= F.col("bound")).select(
                "pair", "f_distance", "final", F.col("node").alias("tip"),
                F.when(F.col("o_at") > F.col("d_at"), -F.col("o_edge")).otherwise(F.col("o_edge")).alias("within")), "proven")
        passed = labels.join(proven.filter(F.col("tip").isNotNull()).select("pair", "f_distance"), "pair").filter(
            F.col("dist") + F.col("ahead") <= F.col("f_distance") + 1e-6).select("pair", "node", "dist", "step", "back")
        solved, near = (x if y is None else y.unionByName(x) for x, y in ((proven, solved), (passed, near)))
        open_pairs, remaining = cut_counted(
            open_pairs.join(proven.select("pair"), "pair", "left_anti").withColumn("bound", F.col("bound") * 2),
            "open")
        if not remaining:
            break
    paths = _trace(cut_lineage(near, "near"), solved)
    return cut_lineage(solved.join(paths, "pair", "left").select(
        "pair", "f_distance", F.coalesce("path", F.array("within")).alias("path"), "final"), "solved")


def _starts() -> Column:
    return F.array(
        F.struct(F.col("ou").alias("node"), F.col("o_at").alias("dist"), (-F.col("o_edge")).alias("step"), _ahead("ou").alias("ahead")),
        F.struct(F.col("ov").alias("node"), (F.col("o_len") - F.col("o_at")).alias("dist"),
                 F.col("o_edge").alias("step"), _ahead("ov").alias("ahead")))


def _hop(source: str) -> str:
    """One edge ahead of ``source``, not straight back, inside the bound."""
    return f"""
      SELECT f.pair, s.next AS node, f.dx, f.dy, f.bound, f.dist + s.len AS dist, s.step, f.node AS back,
        hypot(s.x - f.dx, s.y - f.dy) AS ahead
      FROM {source} f JOIN {{steps}} s ON f.node = s.node
      WHERE s.step <> -f.step AND f.dist + s.len + hypot(s.x - f.dx, s.y - f.dy) <= f.bound"""


# A step in SQL: one parse instead of a hundred column calls, which matters in a loop of small jobs.
_STEP_SQL = f"""
WITH hop1 AS ({_hop("{frontier}")}),
{"".join(f"hop{i} AS ({_hop(f'hop{i - 1}')})," for i in range(2, HOPS + 1))}
both AS (
  {" UNION ALL ".join(f"SELECT *, TRUE AS new FROM hop{i}" for i in range(1, HOPS + 1))}
  UNION ALL SELECT pair, node, dx, dy, bound, dist, step, back, ahead, FALSE FROM {{known}})
SELECT pair, node, dx, dy, bound, m.dist, m.step, m.back, m.ahead FROM (
  SELECT pair, node, dx, dy, bound, min(CASE WHEN new THEN struct(dist, step, back, ahead) END) AS m,
    min(CASE WHEN NOT new THEN dist END) AS old
  FROM both GROUP BY pair, node, dx, dy, bound)
WHERE m IS NOT NULL AND (old IS NULL OR m.dist < old - {IMPROVED!r}D)
"""


def _explore(pairs: DataFrame, steps: DataFrame) -> DataFrame:
    """All labels (pair, node, dist, step, back, ahead) within each pair's bound; ``back`` is the node before, NULL
    at the origin's own edge, and ``ahead`` the straight distance left.

    Labels are an append-only table, one folder per step. A step goes ``HOPS`` edges ahead and has a
    single shuffle: candidates and known labels meet in one aggregate per (pair, node), which keeps
    what improved.
    """
    spark = pairs.sparkSession
    root = run_dir(spark, "labels")
    start = (
        pairs.withColumn("s", F.explode(_starts()))
        .filter(F.col("s.dist") + F.col("s.ahead") <= F.col("bound"))
        .groupBy("pair", "s.node", "dx", "dy", "bound")
        .agg(F.min(F.struct("s.dist", "s.step", "s.ahead")).alias("m"))
        .select("pair", "node", "dx", "dy", "bound", "m.dist", "m.step", F.lit(None).cast("long").alias("back"), "m.ahead"))
    schema = start.schema
    step, grown = 0, write_counted(start, f"{root}/step=0")
    while grown:
        frontier = spark.read.schema(schema).parquet(f"{root}/step={step}")
        known = spark.read.schema(schema).parquet(f"{root}/step=*")
        improved = spark.sql(_STEP_SQL, frontier=frontier, steps=steps, known=known)
        step += 1
        grown = write_counted(improved, f"{root}/step={step}")
    everything = spark.read.schema(schema).parquet(f"{root}/step=*")
    return cut_lineage(everything.groupBy("pair", "node").agg(F.min(F.struct("dist", "step", "back", "ahead")).alias("m")).select(
        "pair", "node", "m.*"), "labels")


def _trace(near: DataFrame, proven: DataFrame) -> DataFrame:
    """(pair, path): the steps of each proven route up to its tip, by the last steps of the labels it may pass.

    The nodes 1, 2, 4, ... before each are found by doubling, and going through these tables from the widest to the
    narrowest marks every node before the tip.
    """
    jumps, more = cut_counted(near.filter(F.col("back").isNotNull()).select("pair", "node", "back"), "jumps")
    tables = [jumps]
    while more:
        again = jumps.select("pair", F.col("node").alias("back"), F.col("back").alias("farther"))
        jumps, more = cut_counted(jumps.join(again, ["pair", "back"]).select("pair", "node", F.col("farther").alias("back")), "jumps")
        tables.append(jumps)
    marked = proven.filter(F.col("tip").isNotNull()).select("pair", F.col("tip").alias("node"))
    for jumps in reversed(tables[:-1]):
        marked = marked.unionByName(marked.join(jumps, ["pair", "node"]).select("pair", F.col("back").alias("node"))).distinct()
    return marked.join(near, ["pair", "node"]).groupBy("pair").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dist", "step"))), lambda x: x["step"]).alias("path"))


def shortest_paths(od: DataFrame, ways: DataFrame, max_snap: float | None = None) -> DataFrame:
    """Routes for the distinct (ox, oy, dx, dy) of ``od``, metres.

    Result: ox, oy, dx, dy, f_distance, f_line, route_status (``ok``, ``unreachable``, or ``too_far`` for
    an end more than ``max_snap`` metres off the network; by default no distance is too far).
    """
    pieces = edges(ways)
    belongs = cut_lineage(components(pieces), "components")
    parts = chained(pieces, belongs)
    network = chains(parts)
    od = cut_lineage(od.select("ox", "oy", "dx", "dy").distinct(), "od")
    points = od.select(F.explode(F.array(
        F.struct(F.col("ox").alias("px"), F.col("oy").alias("py")),
        F.struct(F.col("dx").alias("px"), F.col("dy").alias("py")))).alias("p")).select("p.*")
    snapped = cut_lineage(nearest_edge(points, parts, limit=max_snap).join(
        network.join(belongs, F.col("u") == F.col("node")).drop("node"),
        "edge", "left"), "snapped")

    def side(prefix, u, v):
        return snapped.select(
            F.col("px").alias(f"{prefix}x"), F.col("py").alias(f"{prefix}y"),
            F.col("edge").alias(f"{prefix}_edge"), F.col("at").alias(f"{prefix}_at"),
            F.col("u").alias(u), F.col("v").alias(v), F.col("len").alias(f"{prefix}_len"),
            *[F.col(f"{k}{c}").alias(f"{name}{c}") for k, name in (("u", u), ("v", v)) for c in "xy"],
            F.col("component").alias(f"{prefix}_part"),
            F.col("sx").alias(f"{prefix}_sx"), F.col("sy").alias(f"{prefix}_sy"))

    pairs = cut_lineage(
        od.join(side("o", "ou", "ov"), ["ox", "oy"]).join(side("d", "du", "dv"), ["dx", "dy"])
        .withColumn("straight", F.hypot(F.col("o_sx") - F.col("d_sx"), F.col("o_sy") - F.col("d_sy")))
        .withColumn("pair", F.monotonically_increasing_id()), "pairs")
    # Pairs in different components have no route; the others have one, so every search ends.
    asked = pairs.filter(F.col("o_part") == F.col("d_part")).select(
        "pair", "o_edge", "o_at", "ou", "ov", "o_len", "d_edge", "d_at", "du", "dv", "d_len",
        F.col("d_sx").alias("dx"), F.col("d_sy").alias("dy"), "straight", "oux", "ouy", "ovx", "ovy")
    found = search(asked, network)
    lines = path_lines(found, pairs, network, parts)
    far = F.col("o_edge").isNull() | F.col("d_edge").isNull() if max_snap is not None else F.lit(False)
    return pairs.select("pair", "ox", "oy", "dx", "dy", far.alias("far")).join(found.drop("path", "final"), "pair", "left").join(
        lines, "pair", "left").select(
        "ox", "oy", "dx", "dy", "f_distance", "f_line",
        F.when(F.col("f_distance").isNotNull(), "ok").when(F.col("far"), "too_far").otherwise("unreachable").alias("route_status"))


def path_lines(found: DataFrame, pairs: DataFrame, network: DataFrame, parts: DataFrame) -> DataFrame:
    """(pair, f_line): origin point, the vertices passed, destination point.

    The first step of a path is the rest of the origin's edge and the final one leads along the destination's. A step
    meets the vertices of the stretches of ``BLOCK_M`` it passes, so a route costs its own length and not that of the
    chains it lies on; a group here is one route.
    """
    whole = found.join(pairs.select("pair", "o_sx", "o_sy", "o_at", "d_sx", "d_sy", "d_at"), "pair")
    taken = whole.withColumn("steps", F.array_compact(F.concat("path", F.array("final")))).select(
        "pair", "o_at", "d_at", F.size("steps").alias("n"), F.posexplode("steps").alias("i", "step"))
    ahead = F.col("step") > 0
    # where a route begins or ends on the edge, in the edge's own direction; NULL where it goes on to a node
    begin, end = F.when(F.col("i") == 0, F.col("o_at")), F.when(F.col("i") == F.col("n") - 1, F.col("d_at"))
    ranged = taken.join(network.select(F.col("edge").alias("on"), "len"), F.abs("step") == F.col("on")).select(
        "pair", "i", "on", ahead.alias("ahead"), "len", F.when(ahead, begin).otherwise(end).alias("low"), F.when(ahead, end).otherwise(begin).alias("high"))
    first = _block(F.coalesce("low", F.lit(0.0)))
    stretch = ranged.withColumn("block", F.explode(F.when(
        F.col("high").isNull() | F.col("low").isNull() | (F.col("low") <= F.col("high")),
        F.sequence(first, _block(F.coalesce("high", F.col("len") + BLOCK_M))))))
    vertices = parts.select("edge", "from", F.arrays_zip(
        F.col("line").alias("p"), G.cumulative_lengths(F.col("line")).alias("cum")).alias("v")).select("edge", "from", F.inline("v")).select(
        F.col("edge").alias("on"), (F.col("from") + F.col("cum")).alias("at"), "p").withColumn("block", _block(F.col("at")))
    inner = stretch.join(vertices, ["on", "block"]).filter(
        (F.col("low").isNull() | (F.col("at") > F.col("low"))) & (F.col("high").isNull() | (F.col("at") < F.col("high")))
    ).groupBy("pair").agg(F.array_sort(F.collect_list(F.struct(
        "i", F.when(F.col("ahead"), F.col("at")).otherwise(-F.col("at")).alias("along"), "p"))).alias("passed"))
    middle = F.coalesce(F.transform("passed", lambda v: v["p"]), F.array())
    o, d = (F.struct(F.col(f"{k}_sx").alias("x"), F.col(f"{k}_sy").alias("y")) for k in ("o", "d"))
    return whole.join(inner, "pair", "left").select("pair", G.drop_repeated(F.concat(F.array(o), middle, F.array(d))).alias("f_line"))


def _block(at: Column) -> Column:
    """The stretch of an edge that a place on it lies in; the ends may be off by a rounding error."""
    return F.greatest(F.floor(at / BLOCK_M).cast("long"), F.lit(0).cast("long"))
