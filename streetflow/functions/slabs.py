"""Area of the intersection of two unions of convex pieces, on numpy arrays.

At a fixed height every union is a set of x intervals whose ends move linearly between neighbouring
critical heights (vertices and edge crossings). Integrating slab by slab is exact and needs no polygon
construction. Plain array arithmetic over one Arrow batch; Spark does the joining and grouping.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from streetflow.functions import outlines

CHUNK_ELEMENTS = 4_000_000
MOST_PIECES = 24
#: Squares of 200 m end at 20 cm, where pieces 4 m wide that meet them cover most of them whole.
MOST_SPLITS = 10
#: Pieces within a nanometre of a line lie on it.
STRAIGHT_M = 1e-9
PAIRS_AT_ONCE = 4096
FIELDS = ("x0", "y0", "x1", "y1", "x2", "y2")


def rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Arrow list<segment> to (offsets, values[n, 6])."""
    values = column.flatten()
    flat = np.column_stack([values.field(f).to_numpy(zero_copy_only=False) for f in FIELDS]).astype(float)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(lengths)]), flat


def bent(flat: np.ndarray) -> np.ndarray:
    """Which segments (n, 6) have a corner at their end."""
    d, e = flat[:, 2:4] - flat[:, 0:2], flat[:, 4:6] - flat[:, 2:4]
    return np.nan_to_num(d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]) != 0


def _take(offsets: np.ndarray, flat: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """(rows, width, 6); short rows are padded with their own first segment, which leaves a union as it is."""
    start, count = offsets[rows], offsets[rows + 1] - offsets[rows]
    k = np.arange(width)[None, :]
    return flat[start[:, None] + np.where(k < count[:, None], k, 0)]


def polygons(segs: np.ndarray, half: float, corners: bool) -> np.ndarray:
    """(m, k, 6) segments to (m, k or 2k, 4, 2) convex pieces; a missing bevel is a single point."""
    p, q, r = segs[..., 0:2], segs[..., 2:4], segs[..., 4:6]
    d = q - p
    u = d / np.linalg.norm(d, axis=-1, keepdims=True)
    n = np.stack([-u[..., 1], u[..., 0]], axis=-1) * half
    rect = np.stack([p + n, q + n, q - n, p - n], axis=-2)
    if not corners:
        return rect
    e = np.where(np.isnan(r), d, r - q)
    v = e / np.linalg.norm(e, axis=-1, keepdims=True)
    n2 = np.stack([-v[..., 1], v[..., 0]], axis=-1) * half
    side = -np.sign(d[..., 0] * e[..., 1] - d[..., 1] * e[..., 0])[..., None]
    bevel = np.stack([q, q + side * n, q + side * n2, q], axis=-2)
    return np.concatenate([rect, bevel], axis=1)


def _heights(poly: np.ndarray, h: float) -> np.ndarray:
    """Sorted y values between which every boundary is a straight, non-crossing line."""
    m = poly.shape[0]
    a = poly.reshape(m, -1, 2)
    b = np.roll(poly, -1, axis=-2).reshape(m, -1, 2)
    d = b - a
    ys = [a[..., 1]]
    with np.errstate(divide="ignore", invalid="ignore"):
        i, j = np.triu_indices(a.shape[1], 1)
        apart = i // 4 != j // 4  # edges of one convex piece meet only at vertices
        i, j = i[apart], j[apart]
        den = d[:, i, 0] * d[:, j, 1] - d[:, i, 1] * d[:, j, 0]
        w = a[:, j] - a[:, i]
        t = (w[..., 0] * d[:, j, 1] - w[..., 1] * d[:, j, 0]) / den
        s = (w[..., 0] * d[:, i, 1] - w[..., 1] * d[:, i, 0]) / den
        ok = (t > 0) & (t < 1) & (s > 0) & (s < 1)
        if ok.any():
            ys.append(np.where(ok, a[:, i, 1] + t * d[:, i, 1], -h))
        for edge in (-h, h):
            t = (edge - a[..., 0]) / d[..., 0]
            ok = (t > 0) & (t < 1)
            if ok.any():
                ys.append(np.where(ok, a[..., 1] + t * d[..., 1], -h))
    bounds = np.broadcast_to(np.array([-h, h]), (m, 2))
    y = np.sort(np.clip(np.concatenate([*ys, bounds], axis=1), -h, h), axis=1)
    repeated = np.concatenate([np.zeros((m, 1), bool), np.diff(y, axis=1) <= 0], axis=1)
    y = np.sort(np.where(repeated, h, y), axis=1)
    used = int((~repeated).sum(axis=1).max())
    return y[:, : max(used, 2)]


def _sweep(poly: np.ndarray, from_a: np.ndarray, y: np.ndarray, h: float) -> tuple[np.ndarray, np.ndarray]:
    """At heights y (m, s): event positions and, between neighbours, whether both unions cover."""
    a, b = poly, np.roll(poly, -1, axis=-2)
    y4 = y[:, :, None, None]
    ay, by = a[:, None, :, :, 1], b[:, None, :, :, 1]
    hit = (ay > y4) != (by > y4)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = a[:, None, :, :, 0] + (y4 - ay) * ((b - a)[:, None, :, :, 0] / (by - ay))
    lo = np.where(hit, x, np.inf).min(axis=-1)
    hi = np.where(hit, x, -np.inf).max(axis=-1)
    empty = lo > hi
    lo, hi = np.where(empty, -h, np.clip(lo, -h, h)), np.where(empty, -h, np.clip(hi, -h, h))
    pos = np.concatenate([lo, hi], axis=-1)
    order = np.argsort(pos, axis=-1, kind="stable")
    pos = np.take_along_axis(pos, order, -1)
    step = np.concatenate([np.ones(from_a.size, int), -np.ones(from_a.size, int)])
    owner = np.concatenate([from_a, from_a])
    in_a = np.cumsum(np.where(owner, step, 0)[order], axis=-1) > 0
    in_b = np.cumsum(np.where(owner, 0, step)[order], axis=-1) > 0
    return pos, (in_a & in_b)[..., :-1]


def _integrate(pa_: np.ndarray, pb: np.ndarray, h: float) -> np.ndarray:
    """(m, 6): area and the moments x, y, xx, xy, yy of the overlap inside the cell [-h, h]^2.

    Between two heights the x limits are linear in y, so all six integrands are cubic at most and
    two Gauss nodes per slab are exact.
    """
    poly = np.concatenate([pa_, pb], axis=1)
    from_a = np.arange(poly.shape[1]) < pa_.shape[1]
    ys = _heights(poly, h)
    half = np.diff(ys, axis=1) / 2
    mid = (ys[:, 1:] + ys[:, :-1]) / 2
    out = np.zeros((poly.shape[0], 6))
    for sign in (-1.0, 1.0):
        y = mid + sign * half / np.sqrt(3.0)
        x, cover = _sweep(poly, from_a, y, h)
        lo, hi = x[..., :-1], x[..., 1:]
        m0 = np.where(cover, hi - lo, 0.0).sum(-1)
        m1 = np.where(cover, hi**2 - lo**2, 0.0).sum(-1) / 2
        m2 = np.where(cover, hi**3 - lo**3, 0.0).sum(-1) / 3
        for k, v in enumerate((m0, m1, m0 * y, m2, m1 * y, m0 * y * y)):
            out[:, k] += (v * half).sum(1)
    return out


def _reach(flat: np.ndarray, half: float) -> np.ndarray:
    """(n, 4): xmin, ymin, xmax, ymax of the pieces of a segment; bevels stay within ``half`` of its end."""
    ends = flat[:, 0:4].reshape(-1, 2, 2)
    return np.concatenate([ends.min(axis=1) - half, ends.max(axis=1) + half], axis=1)


def _covers(flat: np.ndarray, half: float, at: np.ndarray, h: float) -> np.ndarray:
    """Which segments' rectangles hold the whole square of half side ``h`` around ``at``."""
    d = flat[:, 2:4] - flat[:, 0:2]
    length = np.linalg.norm(d, axis=1)
    u = d / length[:, None]
    w = at - flat[:, 0:2]
    slack = (np.abs(u[:, 0]) + np.abs(u[:, 1])) * h
    run, off = (w * u).sum(axis=1), np.abs(w[:, 0] * u[:, 1] - w[:, 1] * u[:, 0])
    return (run - slack >= 0) & (run + slack <= length) & (off + slack <= half)


def _quarter(offsets: np.ndarray, flat: np.ndarray, rows: np.ndarray, at: np.ndarray, h: float,
             half: float) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of ``rows`` that reach the squares of half side ``h`` around ``at``; one that covers its square suffices."""
    starts, near_flat = _rows_of(offsets, flat, rows)
    row, piece = np.repeat(np.arange(len(rows)), np.diff(starts)), np.arange(len(near_flat))
    box = _reach(near_flat, half)
    near = (box[:, :2] < at[row] + h).all(axis=1) & (box[:, 2:] > at[row] - h).all(axis=1)
    row, piece = row[near], piece[near]
    full = _covers(near_flat[piece], half, at[row], h)
    first = np.full(len(rows), -1)
    first[row[full][::-1]] = piece[full][::-1]
    kept = (first[row] < 0) | (first[row] == piece)
    row, piece = row[kept], piece[kept]
    return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(rows)))]), near_flat[piece]


def _straight(offsets: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose pieces follow each other on one straight line, without a gap, as one piece."""
    count = np.diff(offsets)
    several = np.nonzero(count > 1)[0]
    if not len(several):
        return offsets, flat
    row = np.repeat(np.arange(len(count)), count)
    first = flat[offsets[:-1][count > 0]][np.searchsorted(np.nonzero(count > 0)[0], row)]
    d = first[:, 2:4] - first[:, 0:2]
    u = d / np.linalg.norm(d, axis=1, keepdims=True)
    w0, w1 = flat[:, 0:2] - first[:, 0:2], flat[:, 2:4] - first[:, 0:2]
    off = np.maximum(*(np.abs(w[:, 0] * u[:, 1] - w[:, 1] * u[:, 0]) for w in (w0, w1)))
    start, end = (w0 * u).sum(axis=1), (w1 * u).sum(axis=1)
    order = np.lexsort((end, start, row))
    sorted_row, s, e = row[order], start[order], end[order]
    # pieces in order: each must start no later than the end of the one before it
    gap = np.zeros(len(row), bool)
    gap[1:] = (sorted_row[1:] == sorted_row[:-1]) & (s[1:] > e[:-1])
    nested = np.zeros(len(row), bool)
    nested[1:] = (sorted_row[1:] == sorted_row[:-1]) & (e[1:] < e[:-1])
    bad = np.zeros(len(count), bool)
    np.logical_or.at(bad, row, (off > STRAIGHT_M) | (start >= end))
    np.logical_or.at(bad, sorted_row, gap | nested)
    # a bevel is kept at the end of a run only
    inner = np.concatenate([sorted_row[1:] == sorted_row[:-1], [False]])
    np.logical_or.at(bad, sorted_row, inner & bent(flat)[order])
    one = (count > 1) & ~bad
    if not one.any():
        return offsets, flat
    lead, tail = order[offsets[:-1][one]], order[offsets[1:][one] - 1]
    kept = ~one[row]
    kept[lead] = True
    flat = flat.copy()
    flat[lead, 2:6] = flat[tail, 2:6]
    return np.concatenate([[0], np.cumsum(np.where(one, 1, count))]), flat[kept]


def _sides(a: pa.Array, b: pa.Array, centre: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(offsets, pieces relative to their row's centre) of both columns."""
    out = []
    for col in (a, b):
        offsets, flat = rows(col)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        out.append(_straight(offsets, flat - np.tile(centre[owner], 3)))
    return out


def _clip(poly: np.ndarray, at: np.ndarray, inward: np.ndarray) -> np.ndarray:
    """Convex rings (m, k, 2) cut by one half plane each; short rings repeat their first vertex."""
    d = ((poly - at[:, None, :]) * inward[:, None, :]).sum(axis=-1)
    inside = d >= 0
    after, d2 = np.roll(poly, -1, axis=1), np.roll(d, -1, axis=1)
    cross = inside != (d2 >= 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        met = poly + np.where(cross, d / (d - d2), 0.0)[..., None] * (after - poly)
    m, k = d.shape
    valid = np.stack([inside, cross], axis=-1).reshape(m, 2 * k)
    points = np.stack([poly, met], axis=2).reshape(m, 2 * k, 2)
    count = valid.sum(axis=1)
    order = np.argsort(~valid, axis=1, kind="stable")[:, :max(int(count.max(initial=0)), 3)]
    order = np.where(np.arange(order.shape[1])[None, :] < count[:, None], order, order[:, :1])
    out = np.take_along_axis(points, order[..., None], axis=1)
    return np.where((count > 2)[:, None, None], out, 0.0)


def _in_box(poly: np.ndarray, box: np.ndarray, h: float) -> np.ndarray:
    """(m, 6) as ``_integrate``, of a clockwise ring (m, k, 2) and a rectangle (m, 4, 2).

    Along the rectangle's axis u, the part of each edge between its ends counts with its distance v clamped to the
    rectangle's width; between the places where it is clamped the integrands are cubic at most. Rectangles along the
    axes are cut to the cell; of others the overlap has to lie within it.
    """
    base = (box[:, 0] + box[:, 3]) / 2
    d = box[:, 1] - box[:, 0]
    length = np.linalg.norm(d, axis=1)
    d = d / length[:, None]
    n = np.column_stack([-d[:, 1], d[:, 0]])
    half = np.linalg.norm(box[:, 0] - box[:, 3], axis=1) / 2
    limits = [np.zeros(len(d)), length, -half, half]
    along = (d == 0).any(axis=1)
    for i, axis in ((0, d), (2, n)):
        at = (base * axis).sum(axis=1)
        limits[i] = np.where(along, np.maximum(limits[i], -h - at), limits[i])
        limits[i + 1] = np.where(along, np.maximum(np.minimum(limits[i + 1], h - at), limits[i]), limits[i + 1])
    u0, u1, v0, v1 = (c[:, None] for c in limits)
    w = poly - base[:, None, :]
    u, v = (w * d[:, None, :]).sum(axis=-1), (w * n[:, None, :]).sum(axis=-1)
    du, dv = np.roll(u, -1, axis=1) - u, np.roll(v, -1, axis=1) - v

    def span(low, high, start, step):
        with np.errstate(divide="ignore", invalid="ignore"):
            p, q = (low - start) / step, (high - start) / step
        flat = step == 0
        return np.where(flat, 0.0, np.minimum(p, q)), np.where(flat, 1.0, np.maximum(p, q))

    begin, end = (np.clip(t, 0.0, 1.0) for t in span(u0, u1, u, du))
    first, second = (np.clip(t, begin, end) for t in span(v0, v1, v, dv))
    m = np.zeros((len(d), 6))
    for t0, t1 in ((begin, first), (first, second), (second, end)):
        part = (t1 - t0) / 2
        weight = part * du
        for sign in (-1.0, 1.0):
            t = t0 + part * (1 + sign / np.sqrt(3.0))
            x, y = u + t * du, np.clip(v + t * dv, v0, v1)
            wy, wx = weight * y, weight * y * x
            wyy = wy * y / 2
            for k, c in enumerate((wy, wx, wyy, wx * x, wyy * x, wyy * y * (2 / 3))):
                m[:, k] += c.sum(axis=1)
    area, mu, mv, uu, uv, vv = m.T
    c, s = d.T
    turned = np.column_stack([area, c * mu - s * mv, s * mu + c * mv, c * c * uu - 2 * c * s * uv + s * s * vv,
                              c * s * (uu - vv) + (c * c - s * s) * uv, s * s * uu + 2 * c * s * uv + c * c * vv])
    return np.where(area[:, None] > 0, _moved(turned, base), 0.0)


def _pair_moments(one: np.ndarray, other: np.ndarray, h: float) -> np.ndarray:
    """(m, 6) as ``_integrate``, of two rectangles (m, 4, 2) a row.

    In closed form along the axis of one of them, if that or the other runs along the cell or both meet well inside it.
    """
    out = np.zeros((len(one), 6))

    def along(box):
        return (box[:, 1] == box[:, 0]).any(axis=1)

    low = np.maximum(one.min(axis=1), other.min(axis=1))
    high = np.minimum(one.max(axis=1), other.max(axis=1))
    inside = (low >= -h).all(axis=1) & (high <= h).all(axis=1)
    by_other = along(other) | inside
    by_one = along(one) & ~by_other
    left = ~(by_other | by_one)
    for which, ring, box, how in ((by_other, one, other, _in_box), (by_one, other, one, _in_box), (left, one, other, _clipped)):
        if which.any():
            out[which] = how(ring[which], box[which], h)
    return out


def _clipped(one: np.ndarray, other: np.ndarray, h: float) -> np.ndarray:
    """As ``_pair_moments``, of any two rectangles: one is cut by the other's sides and the cell's."""
    poly = one
    for i in range(4):
        d = other[:, (i + 1) % 4] - other[:, i]
        poly = _clip(poly, other[:, i], np.column_stack([d[:, 1], -d[:, 0]]))  # they run clockwise
    beyond = np.nonzero((np.abs(poly) > h).any(axis=(1, 2)))[0]
    if len(beyond):
        cut = poly[beyond]
        for side in ((1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (0.0, -1.0)):
            inward = np.tile(side, (len(beyond), 1))
            cut = _clip(cut, -h * inward, inward)
        width = max(poly.shape[1], cut.shape[1])
        poly, cut = (np.concatenate([p, np.repeat(p[:, :1], width - p.shape[1], axis=1)], axis=1) for p in (poly, cut))
        poly[beyond] = cut
    x0, y0 = poly[..., 0], poly[..., 1]
    x1, y1 = np.roll(x0, -1, axis=1), np.roll(y0, -1, axis=1)
    c = x1 * y0 - x0 * y1
    out = np.column_stack([
        c.sum(1) / 2, ((x0 + x1) * c).sum(1) / 6, ((y0 + y1) * c).sum(1) / 6, ((x0 * x0 + x0 * x1 + x1 * x1) * c).sum(1) / 12,
        ((x0 * y1 + 2 * x0 * y0 + 2 * x1 * y1 + x1 * y0) * c).sum(1) / 24, ((y0 * y0 + y0 * y1 + y1 * y1) * c).sum(1) / 12])
    return np.where(out[:, :1] > 0, out, 0.0)


def _batches(sides: list, h: float, wa: float, wb: float):
    """(row numbers, shifts from the rows' centres, half side, pieces of a, pieces of b) in chunks of equally many pieces.

    Edge pairs grow with the square of the pieces, so a row with more than ``MOST_PIECES`` a side is split into the four
    quarters of its square until they hold fewer, or ``MOST_SPLITS`` times.
    """
    total = len(sides[0][0]) - 1
    owner, shift = np.arange(total), np.zeros((total, 2))
    for depth in range(MOST_SPLITS + 1):
        (oa, fa), (ob, fb) = sides
        na, nb = np.diff(oa), np.diff(ob)
        filled = (na > 0) & (nb > 0)
        many = filled & (np.maximum(na, nb) > MOST_PIECES) & (depth < MOST_SPLITS)
        for part, pieces_a, pieces_b in _chunks(np.nonzero(filled & ~many)[0], sides, shift, wa, wb):
            yield owner[part], shift[part], h, pieces_a, pieces_b
        split = np.repeat(np.nonzero(many)[0], 4)
        if not len(split):
            return
        h /= 2
        shift = shift[split] + np.tile(h * np.array([(-1, -1), (1, -1), (-1, 1), (1, 1)]), (len(split) // 4, 1))
        sides = [_quarter(offsets, flat, split, shift, h, half) for (offsets, flat), half in zip(sides, (wa, wb))]
        owner = owner[split]


def _chunks(members: np.ndarray, sides: list, shift: np.ndarray, wa: float, wb: float):
    """``members`` with equally many pieces together, their pieces relative to the middle of their squares."""
    if not len(members):
        return
    kinds = []
    for offsets, flat in sides:
        corner = np.zeros(len(offsets) - 1, bool)
        np.logical_or.at(corner, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), bent(flat))
        kinds += [_bucket(np.diff(offsets))[members], corner[members]]
    kinds, which = np.unique(np.column_stack(kinds), axis=0, return_inverse=True)
    which = which.reshape(-1)
    (oa, fa), (ob, fb) = sides
    for g, (na, has_a, nb, has_b) in enumerate(kinds):
        alike = members[which == g]
        edges = 4 * (na * (1 + has_a) + nb * (1 + has_b))
        chunk = max(1, int(CHUNK_ELEMENTS // (edges * edges)))
        for at in range(0, len(alike), chunk):
            part = alike[at:at + chunk]
            move = np.tile(shift[part], 3)[:, None, :]
            yield (part, polygons(_take(oa, fa, part, na) - move, wa, bool(has_a)),
                   polygons(_take(ob, fb, part, nb) - move, wb, bool(has_b)))


def _rows_of(offsets: np.ndarray, flat: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    count = offsets[rows + 1] - offsets[rows]
    piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(offsets[rows], count)
    return np.concatenate([[0], np.cumsum(count)]), flat[piece]


def _moved(m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Area and moments about the centre of a row, from those about a point ``d`` off it."""
    area, x, y, xx, xy, yy = m.T
    dx, dy = d.T
    return np.column_stack([area, x + dx * area, y + dy * area, xx + 2 * dx * x + dx * dx * area,
                            xy + dx * y + dy * x + dx * dy * area, yy + 2 * dy * y + dy * dy * area])


def overlap_moments(a: pa.Array, b: pa.Array, cx: np.ndarray, cy: np.ndarray, size: float,
                    wa: float, wb: float) -> np.ndarray:
    """(n, 6) overlap area and moments per row, relative to the centre of the row's cell."""
    out = np.zeros((len(cx), 6))
    centre = np.column_stack([cx + 0.5, cy + 0.5]) * size
    sides = _sides(a, b, centre)
    single = np.ones(len(cx), bool)
    for offsets, flat in sides:
        single &= np.diff(offsets) == 1
        plain = ~bent(flat[np.minimum(offsets[:-1], max(len(flat) - 1, 0))]) if len(flat) else np.zeros(len(cx), bool)
        single &= plain
    pairs = np.nonzero(single)[0]
    for at in range(0, len(pairs), PAIRS_AT_ONCE):
        part = pairs[at:at + PAIRS_AT_ONCE]
        one, other = (polygons(flat[offsets[part]][:, None, :], w, False)[:, 0]
                      for (offsets, flat), w in zip(sides, (wa, wb)))
        out[part] = _pair_moments(one, other, size / 2)
    rest = np.nonzero(~single)[0]
    left = [_rows_of(offsets, flat, rest) for offsets, flat in sides]
    for part, shift, h, pieces_a, pieces_b in _batches(left, size / 2, wa, wb):
        part = rest[part]
        np.add.at(out, part, _moved(_integrate(pieces_a, pieces_b, h), shift))
    return out


def _bucket(n: np.ndarray) -> np.ndarray:
    """Round piece counts up to 1, 2, 3, 4, 6, 8, 12, ... so that few array shapes occur."""
    steps = np.array(sorted({1, 2, 3} | {2**k for k in range(2, 31)} | {3 * 2**k for k in range(1, 30)}))
    return steps[np.searchsorted(steps, n)]


def _slab_parts(pieces_a: np.ndarray, pieces_b: np.ndarray, h: float) -> tuple[np.ndarray, np.ndarray]:
    """Row number and (left, right at the bottom; right, left at the top) corners (k, 4, 2) of each part."""
    poly = np.concatenate([pieces_a, pieces_b], axis=1)
    from_a = np.arange(poly.shape[1]) < pieces_a.shape[1]
    ys = _heights(poly, h)
    y0, y1 = ys[:, :-1], ys[:, 1:]
    low, cover = _sweep(poly, from_a, y0 + (y1 - y0) * 0.25, h)
    high, _ = _sweep(poly, from_a, y0 + (y1 - y0) * 0.75, h)
    wide = cover & (low[..., 1:] > low[..., :-1]) & (y1 > y0)[..., None]
    r, s, e = np.nonzero(wide)

    def ends(k):
        """x of boundary k at the bottom and the top of its slab."""
        q, t = low[r, s, k], high[r, s, k]
        return q - (t - q) / 2, t + (t - q) / 2

    (lb, lt), (rb, rt) = ends(e), ends(e + 1)
    bottom, top = y0[r, s], y1[r, s]
    return r, np.stack([np.column_stack(c) for c in ((lb, bottom), (rb, bottom), (rt, top), (lt, top))], axis=1)


def _trapezoids(a: pa.Array, b: pa.Array, cx: np.ndarray, cy: np.ndarray, size: float,
                wa: float, wb: float) -> tuple[np.ndarray, np.ndarray]:
    """The overlap of every row inside its cell as disjoint rings (k, 4, 2), ordered by row, and the row of each."""
    centre = np.column_stack([cx + 0.5, cy + 0.5]) * size
    owners, rings = [np.zeros(0, np.int64)], [np.zeros((0, 4, 2))]
    for part, shift, h, pieces_a, pieces_b in _batches(_sides(a, b, centre), size / 2, wa, wb):
        r, corners = _slab_parts(pieces_a, pieces_b, h)
        owners.append(part[r])
        rings.append(corners + (centre[part[r]] + shift[r])[:, None, :])
    owner, ring = np.concatenate(owners), np.concatenate(rings)
    order = np.argsort(owner, kind="stable")
    return owner[order], ring[order]


def overlap_trapezoids(a: pa.Array, b: pa.Array, cx: np.ndarray, cy: np.ndarray, size: float,
                       wa: float, wb: float) -> pa.Array:
    """Per row the overlap inside its cell as disjoint rings: list<list<struct<x, y>>>."""
    owner, ring = _trapezoids(a, b, cx, cy, size, wa, wb)
    flat = ring.reshape(-1, 2)
    points = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["x", "y"])
    lines = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 4), pa.int32()), points)
    per_row = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(cx)))])
    return pa.ListArray.from_arrays(pa.array(per_row, pa.int32()), lines)


def overlap_edges(a: pa.Array, b: pa.Array, cx: np.ndarray, cy: np.ndarray, size: float, wa: float, wb: float) -> pa.Array:
    """Per row the directed boundary of the overlap inside its cell, on a grid of micrometres."""
    owner, edges = outlines.sides(*_trapezoids(a, b, cx, cy, size, wa, wb))
    return outlines.edge_lists(*outlines.cancelled(owner, edges), len(cx))
