"""Valid polygons, precision and dissolve against sampling, flood fill and values worked out by hand."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from parcelspark.functions import geometry as G
from parcelspark.functions import noding as N
from parcelspark.functions import predicates as P
from parcelspark.operators import polygons


def ring(*points):
    return np.array([*points, points[0]], float)


SQUARE = ring((0, 0), (10, 0), (10, 10), (0, 10))

#: Rings, and the sides of each ring of the polygons that they make, and their area.
CASES = {
    "bow tie": ([[ring((0, 0), (10, 10), (10, 0), (0, 10))]], [[3], [3]], 50),
    "spike": ([[ring((0, 0), (10, 0), (10, 10), (5, 10), (5, 15), (5, 10), (0, 10))]], [[5]], 100),
    "valid": ([[SQUARE]], [[4]], 100),
    "hole touching a side": ([[SQUARE, ring((0, 5), (3, 3), (3, 7))]], [[5, 3]], 94),
    "hole touching a corner": ([[SQUARE, ring((0, 0), (3, 1), (1, 3))]], [[4, 3]], 96),
    "hole outside": ([[SQUARE, ring((20, 20), (23, 20), (20, 23))]], [[4], [3]], 104.5),
    "overlapping parts": ([[SQUARE], [SQUARE + 5]], [[6], [6]], 150),
    "one ring round a hole": ([[ring((0, 0), (10, 0), (10, 10), (5, 10), (3, 5), (7, 5), (5, 10), (0, 10))]], [[5, 3]], 90),
    "twice around": ([[np.vstack([SQUARE[:-1], SQUARE])]], [], 0),
    "a line": ([[ring((0, 0), (10, 10), (5, 5))]], [], 0),
    "nothing": ([], [], 0),
}


@pytest.mark.parametrize("name", list(CASES))
def test_made_valid(name):
    given, want, area = CASES[name]
    made, changed = N.make_valid(given)
    assert [[len(r) - 1 for r in p] for p in made] == want and G.area(made) == pytest.approx(area)
    assert changed == (name not in ("valid", "nothing", "hole touching a corner")) and N.is_valid(made) if made else True


@pytest.mark.parametrize("digits", [0, 1, 6])
def test_random_rings_keep_their_land(digits):
    rng = np.random.default_rng(digits)
    for n in range(6, 22):
        given = [[ring(*np.round(rng.uniform(0, 20, (n, 2)), digits).tolist())]]
        made, _ = N.make_valid(given)
        xy = rng.uniform(-1, 21, (2000, 2))
        assert (G.contains_all(G.closed(given), xy) == (G.contains_all(made, xy) if made else False)).all()
        assert not made or N.is_valid(made)
        assert G.area(made) == pytest.approx(G.overlap_area(G.closed(given), [G.closed(given)]), abs=1e-6)


def test_precision():
    one = N.set_precision([[ring((0.3, -0.2), (10.3, -0.2), (10.3, 0.2), (9.6, 0.2), (9.6, 9.8), (0.3, 9.8))]], 0)
    assert len(one) == 1 and G.area(one) == 100 and (np.concatenate(one[0]) % 1 == 0).all()
    assert N.set_precision([[ring((0, 0), (10, 0.3), (10, 0.4))]], 0) == []
    # a neck that is narrower than the grid parts in two
    two = N.set_precision([[ring((0, 0), (4, 0), (5, 1.9), (6, 0), (10, 0), (10, 4), (6, 4), (5, 2.1), (4, 4), (0, 4))]], 0)
    assert len(two) == 2


def box(x, y, w, h):
    return [[ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))]]


def shapes(spark, rows):
    return spark.createDataFrame([(*r[:-1], bytearray(G.to_wkb(r[-1])) if r[-1] else None) for r in rows], "bsm long, code string, name string, geometry binary")


def parts(cells):
    """Sets of unit cells that are connected by sides."""
    left, out = set(cells), []
    while left:
        todo = [left.pop()]
        out.append(set(todo))
        while todo:
            x, y = todo.pop()
            for c in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if c in left:
                    left.remove(c)
                    todo.append(c)
                    out[-1].add(c)
    return out


def test_dissolve_equals_flood_fill(spark):
    rng = np.random.default_rng(4)
    cells = {k: {(int(x), int(y)) for x, y in zip(*np.nonzero(rng.random((14, 14)) < 0.6), strict=True)} for k in ("a", "b", None)}
    rows = [(i, k, "n", box(x, y, 1, 1)) for k, c in cells.items() for i, (x, y) in enumerate(sorted(c))]
    got = {r.code: r for r in polygons.dissolve(shapes(spark, [*rows, (99, "a", "n", None)]), ["code"]).collect()}
    assert got.keys() == cells.keys()
    for k, c in cells.items():
        frame = {(x, y) for x in range(-1, 15) for y in range(-1, 15)}
        holes = sum(len(parts(frame - p)) - 1 for p in parts(c))  # those that touch the outside at a corner are holes too
        g = G.from_wkb(bytes(got[k].geometry))
        assert got[k].area == len(c) == G.area(g) and got[k].n_polygons == len(parts(c)) and got[k].n_rings == len(parts(c)) + holes
        assert got[k].n_parcels == len(c) + (k == "a") and N.is_valid(G.repair(g))
        assert got[k].length == sum((x + a, y + b) not in c for x, y in c for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))


def test_dissolve_without_common_vertices_and_with_overlaps(spark):
    """A long side against two short ones, an overlap, a parcel twice, and land within land."""
    rows = [(1, "a", "n", box(0, 0, 4, 4)), (2, "a", "n", box(4, 0, 2, 2)), (3, "a", "n", box(4, 2, 2, 2)), (4, "a", "n", box(5, 1, 3, 2)), (5, "a", "n", box(1, 1, 1, 1)), (6, "a", "n", box(0, 0, 4, 4))]
    (r,) = polygons.dissolve(shapes(spark, rows), ["code", "name"]).collect()
    assert (r.code, r.name, r.n_polygons, r.n_rings, r.n_parcels) == ("a", "n", 1, 1, 6) and r.area == pytest.approx(28) and r.length == pytest.approx(24)
    assert polygons.dissolve(shapes(spark, rows).where("false"), ["code"]).count() == 0


def test_admin_proxy(spark):
    code = "511011001001"
    rows = [(1, code, "v", box(0, 0, 1, 1)), (2, code, "v", box(1, 0, 1, 1)), (3, code[:9], "t", box(9, 9, 1, 1))]
    got = {r.XZQDM: r for r in polygons.admin_proxy(shapes(spark, rows).withColumnsRenamed({"code": "qsdwdm", "name": "qsdwmc"})).collect()}
    assert got[code].admin_level == "village" and got[code].area == 2 and got[code].admin_parent_code == code[:9] and got[code[:9]].admin_level == "township"


def test_noding_is_complete():
    """After noding no two pieces meet but at ends, on a grid and without."""
    rng = np.random.default_rng(11)
    s = rng.uniform(0, 10, (60, 4))
    for digits in (None, 3):
        pieces, own = N.noded(s, digits)
        assert len(N.noded(pieces, None, 1)[0]) == len(pieces) or digits is None
        assert set(own) == set(range(60))
        mid = (pieces[:, :2] + pieces[:, 2:]) / 2
        d = s[own, 2:] - s[own, :2]
        off = np.abs((mid - s[own, :2])[:, 0] * d[:, 1] - (mid - s[own, :2])[:, 1] * d[:, 0]) / np.hypot(*d.T)
        assert off.max() < 1e-9 if digits is None else off.max() < 3e-3
    assert len(P.sides([])) == 0


def test_many_are_made_valid_like_each(spark):
    """Shapes in common arrays come out as each alone does, with other shapes and large ones beside them; and the scan's one task is not the only one (F3, F4)."""
    rng = np.random.default_rng(9)
    some = [g for g, _, _ in CASES.values()]
    some += [[[ring(*np.round(rng.uniform(0, 20, (n, 2)), d).tolist())]] for n in (3, 5, 9, 20, 60) for d in (0, 1, 6)]
    for got, want in ((N.make_all_valid(some), list(map(N.make_valid, some))), ([(g, 0) for g in N.set_all_precisions(some, 0)], [(N.set_precision(g, 0), 0) for g in some])):
        assert [(G.to_wkb(g), c) for g, c in got] == [(G.to_wkb(g), c) for g, c in want]
    from parcelspark.domain import box_polygons

    one = spark.range(100).coalesce(1).selectExpr("id", "id x0", "id y0", "id + 1 x1", "id + 1 y1")
    assert len({r[0] for r in polygons.made_valid(box_polygons(one, "id"), "id").select(F.spark_partition_id()).collect()}) > 1
