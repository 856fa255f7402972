"""Readers of vector and raster files on files made here, geometry, sinks and configuration."""

import json
import sqlite3
import struct
import zlib

import numpy as np
import pytest

from parcelspark.functions import geometry as G
from parcelspark.sources import files, sinks

SQUARE = np.array([[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], float)
HOLE = np.array([[1, 1], [1, 2], [2, 2], [2, 1], [1, 1]], float)


def test_geometry():
    g = [[SQUARE, HOLE], [SQUARE + 10]]
    assert G.area(g) == 31 and G.length(g) == 36 and G.bounds(g) == (0, 0, 14, 14)
    back = G.from_wkb(G.to_wkb(g))
    assert all((a == b).all() for p, q in zip(g, back, strict=True) for a, b in zip(p, q, strict=True))
    assert G.centroid([[SQUARE]]) == (2, 2) and G.contains(g, 3, 3) and not G.contains(g, 1.5, 1.5) and not G.contains(g, 5, 5)
    assert G.contains(g, *G.interior_point(g))
    u = [[np.array([[0, 0], [6, 0], [6, 6], [5, 6], [5, 1], [1, 1], [1, 6], [0, 6], [0, 0]], float)]]
    assert not G.contains(u, *G.centroid(u)) and G.contains(u, *G.interior_point(u))
    bad = [[SQUARE[::-1][:-1], np.zeros((5, 2))], [np.zeros((3, 2))]]
    assert G.signed_area(G.repair(bad)[0][0]) == 16 and len(G.repair(bad)) == 1 and len(G.repair(bad)[0]) == 1
    dense = np.array([[0, 0], [1, 0.01], [2, 0], [4, 0], [4, 4], [0, 4], [0, 0]], float)
    assert len(G.simplify(dense, 0.1)) < len(dense)


def test_projection():
    assert G.utm_zone(105.0, 29.5) == 32648 and G.utm_zone(-70.0, -33.0) == 32719
    x, y = G.to_utm(np.array([105.0, 106.0]), np.array([0.0, 29.5]), 32648)
    assert x[0] == pytest.approx(500_000, abs=1e-6) and y[0] == pytest.approx(0, abs=1e-6)
    # one degree east of the meridian at this latitude is 96.9 km on the ellipsoid, less the scale
    assert x[1] - 500_000 == pytest.approx(96_900, rel=2e-3) and y[1] == pytest.approx(3_265_000, rel=2e-3)


def make_gpkg(path):
    db = sqlite3.connect(path)
    db.executescript("CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT); CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INT); CREATE TABLE dltb (fid INTEGER PRIMARY KEY, geom BLOB, BSM INT, DLBM TEXT);")
    db.execute("INSERT INTO gpkg_contents VALUES ('dltb', 'features')")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('dltb', 'geom', 'POLYGON', 3857)")
    head = b"GP" + bytes([0, 0b00000011]) + struct.pack("<i", 3857) + struct.pack("<4d", 0, 4, 0, 4)
    db.execute("INSERT INTO dltb VALUES (1, ?, 101, '0101')", (head + G.to_wkb([[SQUARE, HOLE]]),))
    db.execute("INSERT INTO dltb VALUES (2, NULL, 102, '0301')")
    db.commit()
    db.close()


def test_gpkg(spark, tmp_path):
    make_gpkg(tmp_path / "a.gpkg")
    layers = files.list_layers(spark, str(tmp_path)).collect()
    assert [(r.layer, r.geometry_type, r.srs_id, r.fields) for r in layers] == [("dltb", "POLYGON", 3857, ["fid", "geom", "BSM", "DLBM"])]
    rows = files.read_gpkg(spark, str(tmp_path), "dltb").orderBy("fid").collect()
    assert [r.attrs["DLBM"] for r in rows] == ["0101", "0301"] and rows[1].geometry is None
    good = files.repaired(files.read_gpkg(spark, str(tmp_path), "dltb")).collect()
    assert len(good) == 1 and good[0].area == 15 and G.contains([[SQUARE, HOLE]], good[0].px, good[0].py)
    with pytest.raises(Exception, match="no polygon"):
        files.repaired(files.read_gpkg(spark, str(tmp_path), "dltb"), required=True).collect()
    with pytest.raises(Exception, match="no layer"):
        files.read_gpkg(spark, str(tmp_path), "none").collect()


def test_geojson(spark, tmp_path):
    feature = {"type": "Feature", "properties": {"BSM": 7, "DLBM": "0103"}, "geometry": {"type": "MultiPolygon", "coordinates": [[SQUARE.tolist()]]}}
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature, {"properties": None, "geometry": None}]}))
    rows = files.read_geojson(spark, str(tmp_path)).orderBy("fid").collect()
    assert rows[0].attrs == {"BSM": "7", "DLBM": "0103"} and G.area(G.from_wkb(rows[0].geometry)) == 16 and rows[1].geometry is None


def test_shapefile(spark, tmp_path):
    rings = [SQUARE[::-1], HOLE[::-1], SQUARE[::-1] + 10]
    points = np.concatenate(rings)
    starts = [0, 5, 10]
    body = struct.pack("<i4dii3i", 5, 0, 0, 14, 14, 3, 15, *starts) + points.astype("<f8").tobytes()
    null = struct.pack("<i", 0)
    shp = bytes(100) + b"".join(struct.pack(">ii", i + 1, len(b) // 2) + b for i, b in enumerate((body, null)))
    (tmp_path / "x.shp").write_bytes(shp)
    fields = [(b"DLBM", 4), (b"NAME", 6)]
    head = struct.pack("<BBBBIHH20x", 3, 1, 1, 1, 2, 32 + 32 * 2 + 1, 11) + b"".join(n.ljust(11, b"\0") + b"C" + bytes(4) + bytes([w, 0]) + bytes(14) for n, w in fields) + b"\r"
    (tmp_path / "x.dbf").write_bytes(head + b" 0101" + "水田".encode() + b" 031 " + b"      ")
    rows = files.read_shapefile(spark, str(tmp_path)).orderBy("fid").collect()
    assert rows[0].attrs == {"DLBM": "0101", "NAME": "水田"} and rows[1].attrs == {"DLBM": "031", "NAME": None}
    assert G.area(G.from_wkb(rows[0].geometry)) == 31 and rows[1].geometry is None


def tiff(z, compress, epsg=None):
    rows = [zlib.compress(r.tobytes()) if compress else r.tobytes() for r in z.astype("<f4")]
    data, offsets = b"", []
    for r in rows:
        offsets.append(8 + len(data))
        data += r
    extra, entries = b"", []
    at = 8 + len(data)

    def tag(number, kind, values):
        nonlocal extra
        raw = values if kind == 2 else struct.pack(f"<{len(values)}" + {3: "H", 4: "I", 12: "d"}[kind], *values)
        n = len(values)
        if len(raw) > 4:
            entries.append(struct.pack("<HHII", number, kind, n, at + len(extra)))
            extra += raw
        else:
            entries.append(struct.pack("<HHI", number, kind, n) + raw.ljust(4, b"\0"))

    h, w = z.shape
    for t in ((256, 3, [w]), (257, 3, [h]), (258, 3, [32]), (259, 3, [8 if compress else 1]), (273, 4, offsets), (277, 3, [1]), (278, 3, [1]), (279, 4, [len(r) for r in rows]), (339, 3, [3]), (33550, 12, [2.0, 2.0, 0.0]), (33922, 12, [0, 0, 0, 100.0, 200.0, 0]), *([(34735, 3, [1, 1, 0, 3, 1024, 0, 1, 2 if epsg == 4326 else 1, 1025, 0, 1, 1, 2048 if epsg == 4326 else 3072, 0, 1, epsg])] if epsg else []), (42113, 2, b"-9999\0")):
        tag(*t)
    return b"II*\0" + struct.pack("<I", at + len(extra)) + data + extra + struct.pack("<H", len(entries)) + b"".join(entries) + bytes(4)


@pytest.mark.parametrize("compress", [False, True])
def test_geotiff(spark, tmp_path, compress):
    z = np.array([[1.0, 2.0, 3.0], [4.0, -9999.0, 6.0]])
    (tmp_path / "a.tif").write_bytes(tiff(z, compress))
    got, nodata, transform = files.parse_tiff(tiff(z, compress))
    assert (got == z).all() and nodata == -9999 and transform == (100.0, 2.0, 200.0, -2.0)
    rows = files.read_geotiff(spark, str(tmp_path)).orderBy("row", "col").collect()
    assert [r.z for r in rows] == [1, 2, 3, 4, None, 6]


def test_tiles_lie_on_one_grid(spark, tmp_path):
    """Two tiles side by side; the second begins three cells to the right."""
    z = np.arange(6.0).reshape(2, 3)
    (tmp_path / "a.tif").write_bytes(tiff(z, True))
    second = tiff(z + 10, False).replace(struct.pack("<6d", 0, 0, 0, 100.0, 200.0, 0), struct.pack("<6d", 0, 0, 0, 106.0, 200.0, 0))
    (tmp_path / "b.tif").write_bytes(second)
    got = {(r.row, r.col): r.z for r in files.read_geotiff(spark, str(tmp_path)).collect()}
    assert got == {(r, c): float(v) for r in range(2) for c, v in enumerate([*z[r], *(z[r] + 10)])}
    assert files.raster_transform(spark, str(tmp_path)) == (100.0, 2.0, 200.0, -2.0)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 0, 2, 2)], "bsm long, x0 long, y0 long, x1 long, y1 long")
    feature = json.loads(sinks.geojson_features(df, ["bsm"]).first().value)
    assert feature["properties"] == {"bsm": 1} and len(feature["geometry"]["coordinates"][0]) == 5
    sinks.write_layers({"a": df, "b": df.drop("x1")}, str(tmp_path / "layers"))
    assert {r.layer for r in spark.read.parquet(str(tmp_path / "layers")).collect()} == {"a", "b"}
    sinks.csv_summary(df, str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbfbsm")
    assert all(len(r.sha256) == 64 for r in sinks.output_manifest(spark, str(tmp_path / "layers" / "layer=a")).collect())
    with pytest.raises(ValueError, match="finite"):
        sinks.report_json({"a": [{"b": float("nan")}]})
