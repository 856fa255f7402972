"""Partitioned sources: byte ranges, pushed conditions, mosaics, counts and coordinate systems."""

import sqlite3
import struct
import zlib

import numpy as np
import pytest
from test_files import tiff
from test_fusion import box

from parcelspark.functions import crs as C
from parcelspark.operators.resample import Grid
from parcelspark.sources import files, geopackage, raster, stores, writers


def blocked(z, kind, size, predictor=1, compression=8, big=False, area_or_point=1, epsg=32648):
    """A tiled TIFF, classic or big, of any sample type, with a predictor and a compression."""
    dtype = np.dtype(kind)
    h, w = z.shape
    padded = np.zeros((-(-h // size) * size, -(-w // size) * size), dtype)
    padded[:h, :w] = z
    parts = []
    for r in range(0, padded.shape[0], size):
        for c in range(0, padded.shape[1], size):
            t = padded[r : r + size, c : c + size]
            if predictor == 2:
                t = np.concatenate([t[:, :1], np.diff(t, axis=1)], 1)
                raw = t.astype(dtype).tobytes()
            elif predictor == 3:
                b = t.astype(dtype.newbyteorder(">")).view(np.uint8).reshape(size, size, dtype.itemsize).transpose(0, 2, 1).reshape(size, -1)
                raw = np.concatenate([b[:, :1], np.diff(b, axis=1)], 1).astype(np.uint8).tobytes()
            else:
                raw = t.tobytes()
            if compression == 8:
                raw = zlib.compress(raw)
            elif compression == 50000:
                import zstandard

                raw = zstandard.ZstdCompressor().compress(raw)
            parts.append(raw)
    start = 16 if big else 8
    offsets = start + np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
    data = b"".join(parts)
    word, n_word, slot = ("Q", "Q", 8) if big else ("I", "H", 4)
    codes = {3: "H", 4: "I", 12: "d", 16: "Q"}
    sample = {"u": 1, "i": 2, "f": 3}[dtype.kind]
    keys = [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, area_or_point, 3072, 0, 1, epsg]
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [8 * dtype.itemsize]), (259, 3, [compression]), (277, 3, [1]), (317, 3, [predictor]), (322, 4, [size]), (323, 4, [size]), (324, 16 if big else 4, offsets.tolist()), (325, 4, [len(p) for p in parts]), (339, 3, [sample]), (33550, 12, [30.0, 30.0, 0.0]), (33922, 12, [0, 0, 0, 500000.0, 3300000.0, 0]), (34735, 3, keys)]
    at = start + len(data)
    entries, extra = b"", b""
    base = at + struct.calcsize("<" + n_word) + len(tags) * (12 + 8 * big - 0 if not big else 20) + struct.calcsize("<" + word)
    for tag, kind_code, values in tags:
        raw = struct.pack(f"<{len(values)}{codes[kind_code]}", *values)
        entries += struct.pack("<HH" + word, tag, kind_code, len(values))
        if len(raw) > slot:
            entries += struct.pack("<" + word, base + len(extra))
            extra += raw
        else:
            entries += raw.ljust(slot, b"\0")
    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, at) if big else struct.pack("<2sHI", b"II", 42, at)
    return head + data + struct.pack("<" + n_word, len(tags)) + entries + struct.pack("<" + word, 0) + extra


@pytest.mark.parametrize(("kind", "predictor", "compression", "big"), [("<f4", 1, 1, False), ("<f4", 3, 8, False), ("<f8", 3, 50000, True), ("<i2", 2, 8, False), ("<u1", 1, 8, True)])
def test_formats(tmp_path, spark, kind, predictor, compression, big):
    z = np.random.default_rng(1).integers(1, 200, (37, 45)).astype(kind)
    (tmp_path / "a.tif").write_bytes(blocked(z, kind, 16, predictor, compression, big))
    h = raster.header(str(tmp_path / "a.tif"))
    assert (h.rows, h.cols, h.block, h.epsg, h.grid) == (37, 45, (16, 16), 32648, Grid(500000.0, 30.0, 3300000.0, -30.0, 37, 45))
    got = raster.read_cells(spark, [h]).toPandas()
    back = np.full((37, 45), np.nan)
    back[got["row"], got["col"]] = got["z"]
    assert len(got) == 37 * 45 and (back == z).all()


def test_many_tasks_and_pushed_bounds(tmp_path, spark):
    """Runs of blocks are partitions; conditions on rows and columns leave out whole runs."""
    z = np.arange(64 * 64, dtype="<f4").reshape(64, 64)
    (tmp_path / "a.tif").write_bytes(blocked(z, "<f4", 8))
    found = raster.headers("file://" + str(tmp_path))
    df = raster.read_cells(spark, found, 128)
    assert df.rdd.getNumPartitions() == 32
    some = df.where("row BETWEEN 20 AND 25 AND col >= 56")
    assert some.rdd.getNumPartitions() == 2 and sorted(r.z for r in some.collect()) == sorted(float(64 * r + c) for r in range(20, 26) for c in range(56, 64))
    assert df.where("row = 70").count() == 0 and df.where("row IN (3, 60) AND col < 2").count() == 4


def test_points_lie_at_cell_centres(tmp_path):
    (tmp_path / "a.tif").write_bytes(blocked(np.ones((4, 4), "<f4"), "<f4", 16, area_or_point=2))
    assert raster.header(str(tmp_path / "a.tif")).grid.x0 == 499985.0


def test_elevation_is_mosaicked_and_cropped(tmp_path, spark):
    a, b = tmp_path / "a.tif", tmp_path / "b.tif"
    a.write_bytes(tiff(np.full((10, 10), 5.0), True, 32648))
    shifted = tiff(np.full((10, 10), 7.0), False, 32648).replace(struct.pack("<6d", 0, 0, 0, 100.0, 200.0, 0), struct.pack("<6d", 0, 0, 0, 116.0, 200.0, 0))
    b.write_bytes(shifted)
    model = raster.read_elevation(spark, str(tmp_path), (104.0, 190.0, 118.0, 194.0))
    cells = {(r.row, r.col): r.z for r in model.cells.collect()}
    # two tiles of ten columns share two; bounds meet rows 3 to 5 and columns 2 to 9, with three cells around
    assert model.crs.epsg == 32648 and (model.grid.rows, model.grid.cols) == (10, 18)
    assert cells == {(r, c): 5.0 if c < 10 else 7.0 for r in range(0, 9) for c in range(0, 13)}
    with pytest.raises(raster.RasterError, match="overlap"):
        raster.read_elevation(spark, str(tmp_path), (900.0, 190.0, 918.0, 194.0))
    (tmp_path / "c.tif").write_bytes(tiff(np.ones((2, 2)), True, 32649))
    with pytest.raises(raster.RasterError, match="systems"):
        raster.headers(str(tmp_path))
    with pytest.raises(raster.RasterError, match="not a TIFF"):
        (tmp_path / "d.tif").write_bytes(b"nothing here at all")
        raster.header(str(tmp_path / "d.tif"))


@pytest.fixture
def package(spark, tmp_path):
    bow = bytearray(struct.pack("<BIII", 1, 3, 1, 5) + np.array([[50, 0], [60, 10], [60, 0], [50, 10], [50, 0]], "<f8").tobytes())
    rows = [(i, f"c{i % 3}", box(10 * i, 0, 10 * i + 5, 5)) for i in range(9)] + [(9, "c0", bow), (10, "c0", None)]
    path = str(tmp_path / "a.gpkg")
    writers.write_gpkg({"land": spark.createDataFrame(rows, "n int, code string, geometry binary"), "empty": spark.createDataFrame(rows[:1], "n int, code string, geometry binary").where("false")}, path, 32648)
    return path


def test_layer_in_ranges_with_conditions(spark, package):
    df = geopackage.read_layer(spark, package, "land", features=4)
    assert df.rdd.getNumPartitions() == 3
    whole = files.read_gpkg(spark, package, "land")
    assert sorted((r.fid, r.attrs["code"], r.geometry) for r in df.collect() if r.geometry) == sorted((r.fid, r.attrs["code"], r.geometry) for r in whole.collect() if r.geometry)
    some = [r.attrs["n"] for r in geopackage.read_layer(spark, package, "land", "code = 'c1' AND n > 1", features=4).collect()]
    assert sorted(some) == ["4", "7"] == sorted(r.attrs["n"] for r in files.read_gpkg(spark, package, "land", "code = 'c1' AND n > 1").collect())
    with pytest.raises(geopackage.LayerReadError, match="no layer"):
        geopackage.read_layer(spark, package, "none")


def test_the_tree_of_the_file_prunes(spark, package):
    db = sqlite3.connect(package)
    db.execute("CREATE VIRTUAL TABLE rtree_land_geom USING rtree(id, minx, maxx, miny, maxy)")
    db.executemany("INSERT INTO rtree_land_geom VALUES (?, ?, ?, 0, 5)", [(i + 1, 10 * i, 10 * i + 5) for i in range(9)])
    db.commit()
    db.close()
    got = geopackage.read_layer(spark, package, "land", box=(22.0, 0.0, 41.0, 5.0)).collect()
    assert sorted(r.attrs["n"] for r in got) == ["2", "3", "4"]


def test_counts_come_with_the_rows(spark, package):
    df, seen = geopackage.read_polygon_layer(spark, package, "land", False)
    rows = {int(r.attrs["n"]): r for r in df.collect()}
    assert len(rows) == 10 and rows[9].area == pytest.approx(50)
    assert seen.get == {"source_feature_count": 11, "invalid_geometry_repaired": 1, "empty_or_non_polygon_dropped": 1}
    with pytest.raises(Exception, match="no polygon"):
        geopackage.read_polygon_layer(spark, package, "land", True)[0].collect()
    with pytest.raises(geopackage.LayerReadError, match="no features"):
        geopackage.read_polygon_layer(spark, package, "empty", False)


def test_a_layer_needs_a_system(spark, package):
    assert geopackage.layer_crs(package, "land").same(C.from_epsg(32648))
    db = sqlite3.connect(package)
    db.execute("UPDATE gpkg_geometry_columns SET srs_id = -1")
    db.commit()
    db.close()
    with pytest.raises(geopackage.LayerReadError, match="no coordinate system"):
        geopackage.read_polygon_layer(spark, package, "land", False)


def test_paths(tmp_path):
    (tmp_path / "a b.tif").write_bytes(b"x")
    for p in (str(tmp_path), "file:" + str(tmp_path), "file://" + str(tmp_path)):
        (found,) = stores.listed(p, "*.tif")
        assert stores.local(found) == str(tmp_path / "a b.tif") and stores.reachable(found)
    assert not stores.reachable("viewfs://store/a") and not stores.reachable(str(tmp_path / "none"))


def test_placeholder(spark, tmp_path):
    from parcelspark import fuse

    parcels = spark.createDataFrame([(1, box(2, 3, 10, 12)), (2, box(20, 3, 40, 9))], "bsm long, geometry binary")
    for epsg in (32648, 4326):
        fuse.write_placeholder(parcels, str(tmp_path / "p.tif"), epsg)
        h = raster.header(str(tmp_path / "p.tif"))
        assert (h.grid, h.epsg, h.nodata) == (Grid(2.0, 38.0, 12.0, -9.0, 1, 1), epsg, -9999.0)
        assert [tuple(r)[1:] for r in raster.read_cells(spark, [h]).collect()] == [(0, 0, 0.0)]
    with pytest.raises(raster.RasterError):
        fuse.write_placeholder(parcels.where("false"), str(tmp_path / "p.tif"), 32648)
