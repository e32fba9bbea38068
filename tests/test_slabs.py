"""Overlap area on arrays: closed forms and invariants for lines in any direction."""

import numpy as np
import pyarrow as pa
import pytest

from streetflow.functions import outlines, slabs

SIZE = 1000.0
TYPE = pa.list_(pa.struct([(f, pa.float64()) for f in slabs.FIELDS]))


def pieces(line):
    line = [tuple(map(float, p)) for p in line]
    out = []
    for i in range(len(line) - 1):
        nxt = line[i + 2] if i + 2 < len(line) else (None, None)
        out.append(dict(zip(slabs.FIELDS, (*line[i], *line[i + 1], *nxt))))
    return out


def area(a, b):
    """Overlap of two buffered lines (or lists of lines) around the middle of cell (0, 0)."""
    cols = []
    for side in (a, b):
        lines = side if isinstance(side[0], list) else [side]
        cols.append(pa.array([[p for ln in lines for p in pieces(ln)]], TYPE))
    return slabs.overlap_moments(*cols, np.zeros(1), np.zeros(1), SIZE, 2.0, 2.0)[0]


def turned(line, angle, shift=(0.0, 0.0), centre=(500.0, 500.0)):
    c, s = np.cos(angle), np.sin(angle)
    return [(centre[0] + c * (x - centre[0]) - s * (y - centre[1]) + shift[0],
             centre[1] + s * (x - centre[0]) + c * (y - centre[1]) + shift[1]) for x, y in line]


BENT = [(300, 500), (450, 520), (520, 430), (700, 610)]


@pytest.mark.parametrize("theta", [0.3, 0.7, 1.1, np.pi / 2, 2.0, 2.9])
def test_crossing_is_width_squared_over_sine(theta):
    line = [(300, 500), (700, 500)]
    assert area(line, turned(line, theta))[0] == pytest.approx(16 / np.sin(theta), rel=1e-9)


@pytest.mark.parametrize("theta", [0.0, 0.4, 1.3, 2.2])
def test_line_with_itself_is_length_times_width(theta):
    line = turned([(300, 500), (700, 500)], theta)
    assert area(line, line)[0] == pytest.approx(1600, rel=1e-9)


def test_symmetric_and_bounded():
    other = turned(BENT, 0.15)
    ab, ba = area(BENT, other)[0], area(other, BENT)[0]
    assert ab == pytest.approx(ba, rel=1e-9)
    assert ab <= min(area(BENT, BENT)[0], area(other, other)[0]) + 1e-6


@pytest.mark.parametrize("theta", [0.5, 1.9, 4.0])
def test_rigid_motion(theta):
    other = turned(BENT, 0.05, (0, 1))
    moved = area(turned(BENT, theta, (20, -30)), turned(other, theta, (20, -30)))[0]
    assert moved == pytest.approx(area(BENT, other)[0], rel=1e-8)


def test_splitting_a_street_changes_nothing():
    whole = [(300, 500), (700, 500)]
    trip = turned(whole, 0.01)
    split = [[(300, 500), (470, 500)], [(430, 500), (700, 500)]]
    np.testing.assert_allclose(area(trip, split), area(trip, whole), rtol=1e-9, atol=1e-6)


def test_cells_add_up():
    a, b = pieces(BENT), pieces(turned(BENT, 0.02))
    total = 0.0
    for i in range(10):
        for j in range(10):
            total += slabs.overlap_moments(pa.array([a], TYPE), pa.array([b], TYPE), np.array([i]), np.array([j]),
                                           100.0, 2.0, 2.0)[0, 0]
    assert total == pytest.approx(area(BENT, turned(BENT, 0.02))[0], rel=1e-9)


def test_against_sampling():
    rng = np.random.default_rng(7)
    other = turned(BENT, 0.03, (0.5, 0.5))
    pts = rng.uniform((280, 410), (720, 630), (400_000, 2))

    def inside(line):
        hit = np.zeros(len(pts), bool)
        segs = np.array([[np.nan if v is None else v for v in p.values()] for p in pieces(line)], float)
        for poly in slabs.polygons(segs[None], 2.0, True)[0]:
            d = np.roll(poly, -1, 0) - poly
            cr = d[:, 0] * (pts[:, None, 1] - poly[:, 1]) - d[:, 1] * (pts[:, None, 0] - poly[:, 0])
            flat = np.abs(d).sum() == 0
            hit |= (~flat) & (np.all(cr >= 0, 1) | np.all(cr <= 0, 1))
        return hit

    sampled = (inside(BENT) & inside(other)).mean() * 440 * 220
    assert area(BENT, other)[0] == pytest.approx(sampled, rel=0.05)


def test_moments_tell_regions_apart():
    trip = [(300, 500), (700, 500)]
    left, right = [(400, 480), (400, 520)], [(600, 480), (600, 520)]
    a, b = area(trip, left), area(trip, right)
    assert a[0] == pytest.approx(b[0]) and abs(a[1] - b[1]) > 1


# ---------------------------------------------------------------- crowded cells

def columns(a, b):
    return [pa.array([[p for ln in side for p in pieces(ln)]], TYPE) for side in (a, b)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quarters_change_nothing(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    a = [[tuple(p) for p in rng.uniform(350, 650, (4, 2))] for _ in range(12)]
    b = [[tuple(p) for p in rng.uniform(350, 650, (3, 2))] for _ in range(9)]
    cols = columns(a, b)
    at = (np.zeros(1), np.zeros(1), SIZE, 2.0, 2.0)
    monkeypatch.setattr(slabs, "MOST_PIECES", 10**6)
    whole = slabs.overlap_moments(*cols, *at)
    for most in (6, 16):
        monkeypatch.setattr(slabs, "MOST_PIECES", most)
        np.testing.assert_allclose(slabs.overlap_moments(*cols, *at), whole, rtol=1e-8, atol=1e-5)


def test_five_thousand_pieces_in_a_cell():
    rng = np.random.default_rng(5)
    start = rng.uniform(20, 180, (5000, 2))
    way = rng.uniform(-15, 15, (5000, 2))
    a = [[tuple(p), tuple(p + d)] for p, d in zip(start, way)]
    b = [[(0, y), (200, y)] for y in range(2, 200, 4)]  # covers the whole cell
    cols = columns(a, b)
    once = slabs.overlap_moments(*cols, np.zeros(1), np.zeros(1), 200.0, 2.0, 2.0)[0, 0]
    # a raster of a tenth of a metre
    axis = np.arange(0.05, 200, 0.1)
    seen = np.zeros((len(axis), len(axis)), bool)
    for (p, q) in a:
        p, q = np.array(p), np.array(q)
        lo = np.searchsorted(axis, np.minimum(p, q) - 2)
        hi = np.searchsorted(axis, np.maximum(p, q) + 2)
        x, y = np.meshgrid(axis[lo[0]:hi[0]], axis[lo[1]:hi[1]], indexing="ij")
        d = q - p
        length = np.hypot(*d)
        run = ((x - p[0]) * d[0] + (y - p[1]) * d[1]) / length
        off = np.abs((x - p[0]) * d[1] - (y - p[1]) * d[0]) / length
        seen[lo[0]:hi[0], lo[1]:hi[1]] |= (run >= 0) & (run <= length) & (off <= 2)
    assert once == pytest.approx(seen.sum() * 0.01, rel=2e-3)


# ---------------------------------------------------------------- closed form and straight runs

def test_two_pieces_by_clipping_equal_the_slabs():
    rng = np.random.default_rng(11)
    n, size = 500, 200.0
    a, b = ([[(tuple(rng.uniform(-40, 240, 2))), tuple(rng.uniform(-40, 240, 2))] for _ in range(n)] for _ in range(2))
    for k in range(0, n, 5):  # the same street, and one beside it
        b[k] = a[k] if k % 2 else turned(a[k], 0.0, (1.5, 0.5))
    half = size / 2
    for one, other in zip(a, b):
        cols = columns([one], [other])
        at = (np.zeros(1), np.zeros(1), size, 2.0, 2.0)
        (oa, fa), (ob, fb) = slabs._sides(*cols, np.array([[half, half]]))
        by_slabs = slabs._integrate(slabs.polygons(fa[None], 2.0, False), slabs.polygons(fb[None], 2.0, False), half)
        np.testing.assert_allclose(slabs.overlap_moments(*cols, *at), by_slabs, rtol=1e-9, atol=1e-4)


@pytest.mark.parametrize("theta", [0.0, 0.3])
def test_straight_runs_are_one_piece_and_bends_are_not(theta):
    offsets, flat = slabs.rows(pa.array([
        list(reversed(pieces([(300, 500), (400, 500), (550, 500)]))),
        pieces([(300, 500), (400, 500)]) + pieces([(401, 500), (550, 500)]),  # a gap
        pieces([(300, 500), (400, 500), (400, 550)]),
        pieces([(300, 500), (400, 500), (400, 550)])[:1] + pieces([(400, 500), (500, 500)]),  # a bevel within
        [],
        pieces([(300, 500), (400, 500), (500, 500), (500, 600)])[:2],  # a bevel at the end
    ], TYPE))
    c, s = np.cos(theta), np.sin(theta)
    turn = np.array([[c, s], [-s, c]])
    flat = (flat.reshape(-1, 2) @ turn).reshape(-1, 6)
    counts = np.diff(slabs._straight(offsets, flat)[0]).tolist()
    assert counts[1:5] == [2, 2, 2, 0]
    if theta == 0.0:
        assert counts[0] == 1 and counts[5] == 1


# ---------------------------------------------------------------- outlines

def regions(a, b, size=SIZE, cells=((0, 0),)):
    """Parts of the overlap of lists of lines, its boundary gathered from ``cells``."""
    cols = columns(a, b)
    edges = []
    for i, j in cells:
        got = slabs.overlap_edges(*cols, np.array([i]), np.array([j]), size, 2.0, 2.0).to_pylist()[0]
        edges += [tuple(e.values()) for e in got]
    owner, left = outlines.cancelled(np.zeros(len(edges), np.int64), np.array(edges, np.int64).reshape(-1, 4))
    return outlines.parts([tuple(e) for e in left.tolist()])


GRID = [(i, j) for i in range(10) for j in range(10)]


@pytest.mark.parametrize("theta", [0.0, 0.3, 1.2, np.pi / 2])
def test_a_street_is_one_part_of_four_corners(theta):
    line = turned([(300, 500), (700, 500)], theta)
    for size, cells in ((SIZE, ((0, 0),)), (100.0, GRID)):
        (part,) = regions([line], [line], size, cells)
        assert [len(r) for r in part["rings"]] == [4]
        assert part["area"] == pytest.approx(1600, abs=1e-2) and part["ring_m"] == pytest.approx(808, abs=1e-3)


def test_two_crossings_are_two_parts():
    street = [(300, 500), (700, 500)]
    found = regions([street], [[(400, 400), (400, 600)], [(600, 400), (620, 600)]])
    assert len(found) == 2 and found[0]["area"] == pytest.approx(16)


@pytest.mark.parametrize("theta", [0.0, 0.4])
def test_a_block_has_a_hole(theta):
    # square of streets, each running on past its corners
    block = [turned(ln, theta) for ln in ([(400, 402), (600, 402)], [(400, 598), (600, 598)],
                                          [(402, 400), (402, 600)], [(598, 400), (598, 600)])]
    for size, cells in ((SIZE, ((0, 0),)), (100.0, GRID)):
        (part,) = regions(block, block, size, cells)
        assert [len(r) for r in part["rings"]] == [4, 4]
        assert part["area"] == pytest.approx(200**2 - 192**2, abs=1e-2)
        assert part["ring_m"] == pytest.approx(4 * (200 + 192), abs=1e-3)


def test_parts_that_touch_in_a_point_stay_apart():
    found = regions([[(400, 500), (500, 500)], [(500, 504), (600, 504)]], [[(300, 502), (700, 502)], [(300, 506), (700, 506)],
                                                                            [(300, 498), (700, 498)]])
    assert [p["area"] for p in found] == [pytest.approx(400), pytest.approx(400)]
    assert all(len(p["rings"]) == 1 and len(p["rings"][0]) == 4 for p in found)


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_parts_have_the_area_of_the_overlap_whatever_the_cells(seed):
    rng = np.random.default_rng(seed)
    a = [[tuple(p) for p in rng.uniform(350, 650, (4, 2))] for _ in range(5)]
    b = [[tuple(p) for p in rng.uniform(350, 650, (3, 2))] for _ in range(5)]
    one, many = regions(a, b), regions(a, b, 100.0, GRID)
    whole = slabs.overlap_moments(*columns(a, b), np.zeros(1), np.zeros(1), SIZE, 2.0, 2.0)[0, 0]
    assert sum(p["area"] for p in one) == pytest.approx(whole, abs=1e-2)
    assert len(one) == len(many)
    np.testing.assert_allclose([p["area"] for p in one], [p["area"] for p in many], atol=1e-2)
    np.testing.assert_allclose([p["ring_m"] for p in one], [p["ring_m"] for p in many], atol=1e-2)


def test_equal_regions_have_equal_rings():
    line = turned([(300, 500), (700, 500)], 0.37)
    middle = tuple((np.array(line[0]) * 0.4 + np.array(line[1]) * 0.6))
    whole, split = regions([line], [line]), regions([line], [[line[0], middle, line[1]]])
    assert [p["rings"] for p in whole] == [p["rings"] for p in split]
