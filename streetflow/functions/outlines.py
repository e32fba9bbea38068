"""Outlines of regions that are given as disjoint trapezoids.

Every trapezoid contributes its sides anticlockwise, on a grid of micrometres. Stretches run in both directions cancel,
within a cell and then between the cells of a region, so only the region's boundary is left, with the inside on the left.
Whole numbers make that exact: what is left always closes to rings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PER_METRE = 1_000_000
#: Gaps within a slab, and bends of a boundary, up to this many micrometres come from rounding.
LOOSE = 4
#: Coordinates of finished rings are whole millimetres, so that equal regions have equal rings.
RING_DIGITS = 3
ENDS = ("x0", "y0", "x1", "y1")


def sides(owner: np.ndarray, rings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sides (k, 4) of trapezoids (left and right at the bottom, right and left at the top) and the row of each.

    Trapezoids come ordered by row, slab and place in the slab; neighbours in a slab that share a side are one.
    """
    if not len(rings):
        return owner, np.zeros((0, 4), np.int64)
    whole = np.rint(rings * PER_METRE).astype(np.int64)
    low, high = whole[:-1], whole[1:]
    joined = ((owner[1:] == owner[:-1]) & (rings[1:, 0, 1] == rings[:-1, 0, 1]) & (rings[1:, 2, 1] == rings[:-1, 2, 1])
              & (np.abs(high[:, 0, 0] - low[:, 1, 0]) <= LOOSE) & (np.abs(high[:, 3, 0] - low[:, 2, 0]) <= LOOSE))
    first = np.nonzero(np.concatenate([[True], ~joined]))[0]
    last = np.concatenate([first[1:], [len(whole)]]) - 1
    merged = np.stack([whole[first, 0], whole[last, 1], whole[last, 2], whole[first, 3]], axis=1)
    tall = merged[:, 0, 1] < merged[:, 2, 1]  # a flat one runs to and fro on one line
    merged, rows = merged[tall], owner[first][tall]
    return np.repeat(rows, 4), np.concatenate([merged, np.roll(merged, -1, axis=1)], axis=2).reshape(-1, 4)


def _along(owner: np.ndarray, line: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """What is left of directed stretches on common lines: (owner, line, start, end)."""
    way = np.sign(end - start)
    keys = np.concatenate([np.column_stack([owner, line, np.minimum(start, end)]),
                           np.column_stack([owner, line, np.maximum(start, end)])])
    at, which = np.unique(keys, axis=0, return_inverse=True)
    change = np.zeros(len(at), np.int64)
    np.add.at(change, which.reshape(-1), np.concatenate([way, -way]))
    at, change = at[change != 0], change[change != 0]
    level = np.cumsum(change)
    held = np.nonzero(level)[0]  # the changes of a line add up to 0, so the next place is on the same line
    held = np.repeat(held, np.abs(level[held]))
    ahead, a, b = level[held] > 0, at[held, 2], at[held + 1, 2]
    return at[held, 0], at[held, 1], np.where(ahead, a, b), np.where(ahead, b, a)


def cancelled(owner: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directed edges (k, 4) without the stretches that run both ways; ordered by owner."""
    level, upright = edges[:, 1] == edges[:, 3], edges[:, 0] == edges[:, 2]
    some = ~(level & upright)
    owner, edges, level, upright = owner[some], edges[some], level[some], upright[some]
    o1, y, a, b = _along(owner[level], edges[level, 1], edges[level, 0], edges[level, 2])
    flat = np.column_stack([a, y, b, y])
    o2, x, a, b = _along(owner[upright], edges[upright, 0], edges[upright, 1], edges[upright, 3])
    tall = np.column_stack([x, a, x, b])
    rest = ~(level | upright)
    slant, up = edges[rest], edges[rest, 1] < edges[rest, 3]
    same = np.where(up[:, None], slant, slant[:, [2, 3, 0, 1]])
    kinds, which = np.unique(np.column_stack([owner[rest], same]), axis=0, return_inverse=True)
    net = np.zeros(len(kinds), np.int64)
    np.add.at(net, which.reshape(-1), np.where(up, 1, -1))
    kept = np.repeat(np.arange(len(kinds)), np.abs(net))
    slant = np.where((net[kept] > 0)[:, None], kinds[kept, 1:], kinds[kept][:, [3, 4, 1, 2]])
    owners, out = np.concatenate([o1, o2, kinds[kept, 0]]), np.concatenate([flat, tall, slant])
    order = np.argsort(owners, kind="stable")
    return owners[order], out[order]


def _cross(o, a, b) -> int:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _loops(edges: list[tuple[int, ...]]) -> list[list[tuple[int, int]]]:
    """Rings of directed edges that balance at every vertex, none of which meets a vertex twice.

    Where several edges leave a vertex, the walk keeps to the wedge it came along, so parts that only touch there stay apart.
    """
    leaving: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x0, y0, x1, y1 in edges:
        leaving.setdefault((x0, y0), []).append((x1, y1))
    rings = []
    for start in sorted(leaving):
        while leaving[start]:
            path, place, here, before = [start], {start: 0}, start, None
            while True:
                ways = leaving[here]
                if before is None or len(ways) == 1:
                    there = ways.pop()
                else:
                    back = np.arctan2(before[1] - here[1], before[0] - here[0])
                    there = min(ways, key=lambda p: (back - np.arctan2(p[1] - here[1], p[0] - here[0])) % (2 * np.pi))
                    ways.remove(there)
                if there in place:
                    cut = place[there]
                    rings.append(path[cut:])
                    for p in path[cut + 1:]:
                        del place[p]
                    path = path[:cut + 1]
                    if cut == 0:
                        break
                    before, here = path[-2], there
                else:
                    place[there] = len(path)
                    path.append(there)
                    before, here = here, there
    return rings


def _tidy(ring: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ring without vertices on the line between their neighbours, from its lowest vertex on."""
    ring = list(ring)
    at = ring.index(min(ring, key=lambda p: (p[1], p[0])))
    ring = ring[at:] + ring[:at]
    kept = [ring[0]]
    for k in range(1, len(ring)):
        before, here, after = kept[-1], ring[k], ring[(k + 1) % len(ring)]
        span = max(abs(after[0] - before[0]), abs(after[1] - before[1]))
        forward = (here[0] - before[0]) * (after[0] - here[0]) + (here[1] - before[1]) * (after[1] - here[1]) >= 0
        if not (forward and abs(_cross(before, here, after)) <= LOOSE * span):
            kept.append(here)
    return kept


def _twice_area(ring: list[tuple[int, int]]) -> int:
    return sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:] + ring[:1]))


def _holds(ring: list[tuple[int, int]], x: float, y: float) -> bool:
    inside = False
    for a, b in zip(ring, ring[1:] + ring[:1]):
        if (a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]):
            inside = not inside
    return inside


def parts(edges: list[tuple[int, ...]]) -> list[dict]:
    """Connected parts of the region inside ``edges``, lowest first: rings (outline, then holes), area, ring_m.

    Rings are open and start at their lowest vertex; outlines run anticlockwise, holes clockwise. Slivers that rounding to
    micrometres may leave, of less than a square millimetre, are no parts.
    """
    rings = [(r, a) for r in map(_tidy, _loops(edges)) if (a := _twice_area(r)) and abs(a) >= 2 * 10**6]
    outer = sorted(((r, a) for r, a in rings if a > 0), key=lambda t: (t[0][0][1], t[0][0][0], t[1]))
    holes: list[list] = [[] for _ in outer]
    for ring, area in rings:
        if area < 0:
            x, y = (ring[0][0] + ring[1][0]) / 2, (ring[0][1] + ring[1][1]) / 2
            around = [k for k, (r, _) in enumerate(outer) if _holds(r, x, y)]
            if around:
                holes[min(around, key=lambda k: outer[k][1])].append((ring, area))
    out = []
    for (ring, area), inner in zip(outer, holes):
        inner = sorted(inner, key=lambda t: (t[0][0][1], t[0][0][0]))
        every = [ring] + [r for r, _ in inner]
        out.append({
            "rings": [[{"x": round(x / PER_METRE, RING_DIGITS), "y": round(y / PER_METRE, RING_DIGITS)} for x, y in r]
                      for r in every],
            "area": (area + sum(a for _, a in inner)) / 2 / PER_METRE**2,
            "ring_m": sum(np.hypot(b[0] - a[0], b[1] - a[1]) for r in every for a, b in zip(r, r[1:] + r[:1])) / PER_METRE,
        })
    return out


def edge_lists(owner: np.ndarray, edges: np.ndarray, rows: int) -> pa.Array:
    """One list<struct<x0, y0, x1, y1>> per row."""
    counts = np.bincount(owner, minlength=rows)
    values = pa.StructArray.from_arrays([pa.array(edges[:, k]) for k in range(4)], list(ENDS))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def region_parts(column: pa.Array, kind: pa.DataType) -> pa.Array:
    """Parts per row of list<edge>, edges of all cells of a region together."""
    owner = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    values = column.flatten()
    edges = np.column_stack([values.field(e).to_numpy(zero_copy_only=False) for e in ENDS]).astype(np.int64)
    owner, edges = cancelled(owner, edges)
    bounds = np.searchsorted(owner, np.arange(len(column) + 1))
    return pa.array([parts(list(map(tuple, edges[a:b].tolist()))) for a, b in zip(bounds[:-1], bounds[1:])], kind)
