"""The four-source fixture with values worked out by hand, and polygon overlap against sampling."""

import math

import numpy as np
import pytest

from parcelspark.functions import geometry as G
from parcelspark.operators import fusion, overlay


def box(x0, y0, x1, y1):
    return bytearray(G.to_wkb([[np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]], float)]]))


def test_overlap_area_counts_covered_land_once():
    rng = np.random.default_rng(0)
    star = lambda cx, cy, n: np.array([[cx + r * math.cos(t), cy + r * math.sin(t)] for t, r in zip(np.linspace(0, 2 * math.pi, n, endpoint=False), rng.uniform(1, 4, n), strict=True)])
    close = lambda r: np.vstack([r, r[:1]])
    shape = [[close(star(0, 0, 9))]]
    others = [[[close(star(1, 1, 7))]], [[close(star(-1, 0, 5))]]]
    xs = (np.arange(600) + 0.5) / 600 * 10 - 5
    hits = sum(G.contains(shape, x, y) and any(G.contains(o, x, y) for o in others) for x in xs[::4] for y in xs[::4])
    assert G.overlap_area(shape, others) == pytest.approx(hits * (10 / 150) ** 2, rel=0.03)
    assert G.overlap_area(shape, [shape]) == pytest.approx(G.area(shape)) and G.overlap_area(shape, []) == 0


@pytest.fixture(scope="module")
def sources(spark):
    code = "511011001001"
    rows = [(101, "0101", "水田", box(2, 2, 10, 10)), (102, "0103", "旱地", box(12, 2, 20, 10)), (103, "0301", "乔木林地", box(22, 2, 30, 10)), (104, "1104", "村庄", box(32, 2, 40, 10))]
    parcels = spark.createDataFrame([(b, c, n, code, "测试村", g) for b, c, n, g in rows], "bsm long, dlbm string, dlmc string, qsdwdm string, qsdwmc string, geometry binary")
    zones = lambda *b: spark.createDataFrame([(i, g) for i, g in enumerate(b)], "zone_id long, geometry binary")
    pdt = spark.createDataFrame([(0, "2", "II级", box(0, 0, 45, 15))], "zone_id long, pdjb string, bzpdjb string, geometry binary")
    dem = spark.createDataFrame([(r, c, 100 + 0.05 * c) for r in range(20) for c in range(50)], "row long, col long, z double")
    slope = overlay.horn_slope(dem, 1.0, False).withColumnRenamed("slope", "z")
    return parcels, pdt, zones(box(1, 1, 8, 9)), zones(box(21, 1, 28, 9)), fusion.polygon_slope(parcels, slope, 1.0, (0.0, 20.0))


def test_four_sources(sources):
    parcels, pdt, eco, pbf, slope = sources
    out = fusion.fuse(parcels, slope, pdt, eco, pbf)
    assert out.columns == [*parcels.columns, *fusion.ADDED]
    rows = out.orderBy("bsm").collect()
    assert [r.EXCH_LOCK for r in rows] == [r.LOCK_C2F for r in rows] == [r.LOCK_F2C for r in rows] == [1, 0, 1, 0]
    assert [r.PDT_GRADE for r in rows] == [2] * 4 and [r.DEM_GRADE for r in rows] == [2] * 4 and [r.GRD_MATCH for r in rows] == [1] * 4
    assert [r.category for r in rows] == ["Farmland", "Farmland", "Forest", "Other"]
    assert rows[0].REVIEW_RSN == "CULTIVATED_LAND_IN_ECO_REDLINE" and rows[2].REVIEW_RSN == "FOREST_OVERLAPS_PERMANENT_BASIC_FARMLAND" and rows[1].REVIEW_REQ == 0
    assert rows[0].ECO_OV_M2 == pytest.approx(42) and rows[0].ECO_PCT == pytest.approx(42 / 64 * 100) and rows[0].PDT_OV_PCT == pytest.approx(100)
    assert [r.AREA_M2 for r in rows] == [64] * 4 and [r.slope_pixel_count for r in rows] == [64] * 4
    assert all(r.slope_mean == pytest.approx(math.degrees(math.atan(0.05))) and r.slope_assignment == "pixel" for r in rows)
    assert [r.LOCK_RSN for r in rows] == ["ECO_REDLINE", "", "PERMANENT_BASIC_FARMLAND", ""]


def test_parcels_and_elevation_alone(sources):
    parcels, *_, slope = sources
    rows = fusion.fuse_without_zones(parcels, slope).collect()
    assert len(rows) == 4 and all(r.EXCH_LOCK == 0 and r.PDT_GRADE == -1 and r.CONSTR_STA == "NOT_EVALUATED" for r in rows)


def test_small_parcels_take_the_nearest_cell(spark):
    parcels = spark.createDataFrame([(1, box(2.1, 2.1, 2.3, 2.3)), (2, box(90, 90, 90.1, 90.1))], "bsm long, geometry binary")
    pixels = spark.createDataFrame([(r, c, None if (r, c) == (17, 2) else float(10 * r + c)) for r in range(20) for c in range(20)], "row long, col long, z double")
    rows = {r.bsm: r for r in fusion.polygon_slope(parcels, pixels, 1.0, (0.0, 20.0)).collect()}
    assert rows[1].slope_mean == 162.0 and rows[1].slope_assignment == "representative" and rows[1].slope_pixel_count == 0
    assert rows[2].slope_mean is None and rows[2].slope_assignment is None
