"""Layer roles, and the four-source fixture from files with the values worked out by hand."""

import math
import struct

import numpy as np
import pytest
from test_files import tiff
from test_fusion import box

from parcelspark import fuse
from parcelspark.sources import files, layers, writers


def test_layer_selection():
    have = [("DLTB_2025", "Polygon", ["标识码", "DLBM", "QSDWDM"]), ("STBHHX", "MultiPolygon", ["红线代码"]), ("坡度图", "Polygon", ["PDJB"]), ("roads", "LineString", ["BSM", "DLBM"]), ("YJJBNTBHTB", "Polygon", [])]
    assert [layers.select_layer(have, r) for r in ("parcels", "pdt", "eco", "pbf")] == ["DLTB_2025", "坡度图", "STBHHX", "YJJBNTBHTB"]
    assert layers.score("parcels", "DLTB_2025", have[0][2]) == 100 + 20 + 30 + 25 and layers.score("pbf", "YJJBNTBHTB", []) == 200
    assert layers.select_layer(have[:1], "eco") == "DLTB_2025" and layers.select_layer(have, "eco", "roads") == "roads"
    for wrong in (lambda: layers.select_layer(have, "eco", "none"), lambda: layers.select_layer(have[3:4], "eco"), lambda: layers.select_layer(have + [("DLTB_2024", "Polygon", ["BSM", "DLBM", "QSDWDM"])], "parcels"), lambda: layers.select_layer([("a", "Polygon", []), ("b", "Polygon", [])], "pbf")):
        with pytest.raises(layers.LayerError):
            wrong()


@pytest.fixture(scope="module")
def container(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sources")
    rows = [(101, "0101", "水田", box(2, 2, 10, 10)), (102, "0103", "旱地", box(12, 2, 20, 10)), (103, "0301", "乔木林地", box(22, 2, 30, 10)), (104, "1104", "村庄", box(32, 2, 40, 10))]
    parcels = spark.createDataFrame([(b, c, n, "511011001001", "测试村", g) for b, c, n, g in rows], "`标识码` long, `地类编码` string, `地类名称` string, `权属单位代码` string, `坐落单位名称` string, geometry binary")
    one = lambda fields, *values: spark.createDataFrame([values], f"{fields}geometry binary")
    sources = {"2025地类图斑": parcels, "PDT": one("PDJB int, BZPDJB string, ", 2, "II级", box(0, 0, 45, 15)), "STBHHX": one("`红线代码` string, ", "E1", box(1, 1, 8, 9)), "YJJBNTBHTB": one("`行政区代码` string, ", "511011", box(21, 1, 28, 9))}
    writers.write_gpkg(sources, str(folder / "all.gpkg"), 3857)
    raw = tiff(np.tile(100 + 0.05 * (np.arange(50) + 0.5), (20, 1)), True, 3857)
    raw = raw.replace(struct.pack("<3d", 2.0, 2.0, 0.0), struct.pack("<3d", 1.0, 1.0, 0.0)).replace(struct.pack("<6d", 0, 0, 0, 100.0, 200.0, 0), struct.pack("<6d", 0, 0, 0, 0.0, 20.0, 0))
    (folder / "dem.tif").write_bytes(raw)
    return folder


def test_four_sources_from_files(spark, container):
    path, dem = str(container / "all.gpkg"), str(container / "dem.tif")
    assert layers.select_layers(spark, path) == {"parcels": "2025地类图斑", "pdt": "PDT", "eco": "STBHHX", "pbf": "YJJBNTBHTB"}
    counts = {}
    out = fuse.fuse_files(spark, {"source": path, "dem": dem}, counts=counts)
    assert {k: v.get["source_feature_count"] for k, v in counts.items()} == {"parcels": 4, "pdt": 1, "eco": 1, "pbf": 1}
    rows = out.orderBy("bsm").collect()
    assert [r.BSM_TEXT for r in rows] == ["101", "102", "103", "104"] and [r.EXCH_LOCK for r in rows] == [1, 0, 1, 0] and [r.PDT_GRADE for r in rows] == [2] * 4
    assert rows[0].REVIEW_RSN == "CULTIVATED_LAND_IN_ECO_REDLINE" and rows[2].REVIEW_RSN == "FOREST_OVERLAPS_PERMANENT_BASIC_FARMLAND"
    assert all(r.slope_mean == pytest.approx(math.degrees(math.atan(0.05)), abs=1e-3) for r in rows)
    fuse.write_fused(out, str(container / "fused.gpkg"), 3857)
    again = files.read_gpkg(spark, str(container / "fused.gpkg"), "dltb").orderBy("fid").collect()
    assert sorted(r.attrs["BSM"] for r in again) == ["101", "102", "103", "104"] and {r.attrs["EXCH_LOCK"] for r in again} == {"0", "1"}


def test_parcels_and_elevation_from_files(spark, container):
    path, dem = str(container / "all.gpkg"), str(container / "dem.tif")
    rows = fuse.fuse_files(spark, {"parcels": path, "dem": dem}).collect()
    assert len(rows) == 4 and all(r.EXCH_LOCK == 0 and r.PDT_GRADE == -1 and r.CONSTR_STA == "NOT_EVALUATED" for r in rows)
    with pytest.raises(ValueError, match="zones need"):
        fuse.fuse_files(spark, {"parcels": path, "dem": dem, "pdt": path})
    (container / "plain.tif").write_bytes(tiff(np.ones((4, 4)), True))
    with pytest.raises(ValueError, match="overlap|no coordinate system"):
        fuse.fuse_files(spark, {"parcels": path, "dem": str(container / "plain.tif")})
    far = spark.createDataFrame([(1, box(900, 900, 910, 910))], "bsm long, geometry binary")
    with pytest.raises(ValueError, match="overlap"):
        fuse.slope_of(spark, far, dem)


def test_sources_in_degrees(spark, container, tmp_path):
    """Parcels and elevation in degrees: areas in the UTM zone, slopes by cells measured on the ellipsoid."""
    from parcelspark.functions import crs as C

    utm = C.from_epsg(32648)
    lon, lat = 105.01, 29.99
    d = 0.001
    rows = [(i, "0101", "水田", "511011001001", "村", box(lon + i * d, lat, lon + (i + 1) * d, lat + d)) for i in range(3)]
    parcels = spark.createDataFrame(rows, "BSM long, DLBM string, DLMC string, QSDWDM string, QSDWMC string, geometry binary")
    writers.write_gpkg({"dltb": parcels}, str(tmp_path / "p.gpkg"), 4326)
    step = 0.0001
    z = np.tile(500 + 3.0 * (np.arange(300) + 0.5), (300, 1))
    raw = tiff(z, True, 4326).replace(struct.pack("<3d", 2.0, 2.0, 0.0), struct.pack("<3d", step, step, 0.0)).replace(struct.pack("<6d", 0, 0, 0, 100.0, 200.0, 0), struct.pack("<6d", 0, 0, 0, 105.0, 30.0, 0))
    (tmp_path / "dem.tif").write_bytes(raw)
    out = fuse.fuse_files(spark, {"parcels": str(tmp_path / "p.gpkg"), "dem": str(tmp_path / "dem.tif")}).orderBy("bsm").collect()
    x, y = C.project(utm, np.array([lon, lon + d]), np.array([lat, lat + d]))
    dx = C.metres(105, 30 - 150 * step, 105 + step, 30 - 150 * step)
    assert len(out) == 3 and out[0].AREA_M2 == pytest.approx((x[1] - x[0]) * (y[1] - y[0]), rel=1e-3)
    assert all(r.slope_pixel_count == 100 and r.slope_mean == pytest.approx(math.degrees(math.atan(3 / dx)), rel=1e-3) for r in out)
