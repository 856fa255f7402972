"""Exact predicates and the cell index against whole outlines, on shapes with many points on sides and corners."""

from fractions import Fraction

import numpy as np
import pytest

from parcelspark.functions import geometry as G
from parcelspark.functions import predicates as P
from parcelspark.operators import cellindex, polygons


def star(rng, n, centre, radius, whole):
    a = np.sort(rng.uniform(0, 2 * np.pi, n))
    q = np.stack([np.cos(a), np.sin(a)], 1) * rng.uniform(0.3, 1, n)[:, None] * radius + centre
    q = np.round(q / 2) * 2 if whole else q
    return np.vstack([q, q[:1]])


def test_the_sign_of_a_cross_product_is_exact():
    """Points a rounding unit off a line are told from those on it."""
    a, b = (0.1, 0.1), (12.3, 12.3)
    xs = np.array([0.5, np.nextafter(0.5, 1), np.nextafter(0.5, 0), 7.7])
    assert P.orient(*a, *b, xs, 0.5).tolist() == [0, -1, 1, -1]
    for x, y in [(7.7, 7.7), (0.3, 0.1), (1e-9, 3e-10), (123.456, 41.152)]:
        exact = Fraction(3) * Fraction(y) - Fraction(1) * Fraction(x)
        assert P.orient(0, 0, 3, 1, x, y) == (exact > 0) - (exact < 0)


@pytest.mark.parametrize("size", [4.0, 8.0, 64.0])
@pytest.mark.parametrize("whole", [True, False])
def test_a_cell_says_what_the_whole_outline_says(size, whole):
    rng = np.random.default_rng(int(size) + whole)
    for _ in range(25):
        g = G.repair([[star(rng, 14, (20, 20), 25, whole)], [star(rng, 9, (28, 16), 18, whole)]])
        xy = rng.uniform(-10, 50, (300, 2))
        xy = np.round(xy) if whole else xy
        cells = {(c, r): (f, s) for c, r, f, s in P.cell_sides(g, size)}
        col, row = np.floor(xy / size).astype(int).T
        want = P.locate(g, xy)
        at = np.array([i for i in range(300) if (col[i], row[i]) in cells])
        assert (np.delete(want, at) == -1).all()
        own = [cells[col[i], row[i]] for i in at]
        inside, edge = P.in_cells(*xy[at].T, col[at] * size, row[at] * size, np.array([f for f, _ in own]), np.concatenate([s for _, s in own]), np.repeat(np.arange(len(at)), [len(s) for _, s in own]))
        assert (edge == (want[at] == 0)).all() and ((inside & ~edge) == (want[at] == 1)).all()
        total = sum(G.overlap_area([p], [[p]]) for _, _, p in P.cell_pieces(g, size))
        assert total == pytest.approx(G.overlap_area(g, [g]), rel=1e-9, abs=1e-9)


def test_neighbours_share_no_point_by_the_rule_of_pixels():
    """A split square: every lattice point of it belongs to one half exactly."""
    xy = np.array([(x, y) for x in range(8) for y in range(8)], float)
    halves = [[[np.array([[0, 0], [8, 0], [0, 8], [0, 0]], float)]], [[np.array([[8, 0], [8, 8], [0, 8], [8, 0]], float)]]]
    got = []
    for h in halves:
        (_, _, f, s), = P.cell_sides(h, 16.0)
        n = len(xy)
        got.append(P.in_cells(*xy.T, np.zeros(n), np.zeros(n), np.full(n, f), np.tile(s, (n, 1)), np.repeat(np.arange(n), len(s)))[0])
    assert (got[0] ^ got[1]).all()


def wkb(*rings):
    return bytearray(G.to_wkb([[np.array(r, float)] for r in rings]))


def test_rules_of_the_boundary(spark):
    square = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    zones = spark.createDataFrame([(1, wkb(square)), (2, wkb([(x + 4, y) for x, y in square])), (3, None)], "zone_id long, geometry binary")
    points = spark.createDataFrame([("in", 1.0, 1.0), ("common", 4.0, 2.0), ("corner", 4.0, 4.0), ("out", 9.0, 9.0), ("left", 0.0, 3.0)], "key string, px double, py double")
    got = {rule: sorted(map(tuple, polygons.points_in_polygons(points, zones, 2.0, rule).collect())) for rule in ("within", "intersects", "pixel")}
    assert got["within"] == [("in", 1)]
    assert got["pixel"] == [("common", 2), ("in", 1), ("left", 1)]
    assert got["intersects"] == [("common", 1), ("common", 2), ("corner", 1), ("corner", 2), ("in", 1), ("left", 1)]


def test_overlaps_by_cells(spark):
    rng = np.random.default_rng(8)
    shapes = {k: G.repair([[star(rng, 10, (20, 20), 18, False)]]) for k in range(12)}
    df = spark.createDataFrame([(k, bytearray(G.to_wkb(g))) for k, g in shapes.items()], "bsm long, geometry binary")
    own, zones = df.where("bsm < 6"), df.where("bsm >= 6").withColumnRenamed("bsm", "zone_id")
    left, right = cellindex.piece_index(own, "bsm", 4.0), cellindex.piece_index(zones, "zone_id", 4.0)
    assert right.where("full").count() > 0
    got = {(r.bsm, r.zone_id): r.area for r in cellindex.overlaps(left, right, "bsm", "zone_id").collect()}
    for a in range(6):
        for z in range(6, 12):
            assert got.get((a, z), 0) == pytest.approx(G.overlap_area(shapes[a], [shapes[z]]), abs=1e-9)
    once = {r.bsm: r.area for r in cellindex.covered(left, right, "bsm", "zone_id").collect()}
    for a in range(6):
        assert once[a] == pytest.approx(G.overlap_area(shapes[a], [shapes[z] for z in range(6, 12)]), abs=1e-9)


def test_boxes_are_known_by_their_bounds(spark):
    """Pairs of boxes, pieces inside a box and pieces beside each other read no outline, and shapes beside all zones no ring (F8, F9)."""
    square = lambda k, x, y, w: (k, bytearray(G.to_wkb([[np.array([(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)], float)]])))
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, geometry binary").coalesce(1)
    own = frame([square(1, 1, 1, 2), square(2, 3, 3, 2), square(3, 100, 100, 5), (4, None)], "bsm")
    zones = cellindex.piece_index(frame([square(7, 0, 0, 3.5), square(8, 0, 0, 6)], "zone_id"), "zone_id", 8.0)
    assert cellindex.extent(zones) == (0, 0, 6, 6) and cellindex.extent(zones.where("false")) is None
    left = cellindex.near(own, "bsm", cellindex.extent(zones))
    assert [r.bsm for r in left.orderBy("bsm").collect()] == [1, 2, 4] and cellindex.near(own, "bsm", None).count() == 0
    pairs = cellindex._pairs(cellindex.piece_index(left, "bsm", 8.0), zones.withColumnRenamed("zone_id", "__key"), "__key")
    assert {(r.bsm, r["__zone"]): r.known for r in pairs.collect()} == {(1, 7): 4, (1, 8): 4, (2, 7): 0.25, (2, 8): 4}
    assert {r.bsm: r.area for r in cellindex.covered(cellindex.piece_index(left, "bsm", 8.0), zones, "bsm", "zone_id").collect()} == {1: 4, 2: 4}
