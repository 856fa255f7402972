"""Vector and raster files as DataFrames.

Spark reads the bytes (binaryFile), so any store that Spark reaches works; each
file is parsed in one task. Columns of a layer come as text, the geometry as WKB.
FileGDB has no public reader without native libraries and is not supported; use
Parquet or GeoPackage.
"""

from __future__ import annotations

import json
import sqlite3
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.functions import geometry as G
from parcelspark.functions import noding as N
from parcelspark.scratch import ship

LAYER = "path string, fid long, attrs map<string,string>, geometry binary"
LISTING = "path string, layer string, geometry_type string, srs_id long, fields array<string>"
PIXELS = "path string, row long, col long, z double"


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def _parsed(files: DataFrame, parse, schema: str) -> DataFrame:
    """Rows that parse(path, bytes) gives for each file, in batches."""
    names = [x.split(" ", 1)[0] for x in schema.replace("map<string,string>", "map").split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string()), "array<string>": pa.list_(pa.string())}
    types = [kinds[x.split(" ", 1)[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for r in parse(path, content):
                    rows.append((path, *r))
                    if len(rows) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return files.mapInArrow(run, schema)


def _text(v: object) -> str | None:
    return None if v is None else str(v)


def _open(content: bytes) -> sqlite3.Connection:
    db = sqlite3.connect(":memory:")
    db.deserialize(content)
    return db


def gpkg_blob(blob: bytes | None) -> bytes | None:
    """WKB inside a GeoPackage geometry; null for an empty one."""
    if blob is None or blob[:2] != b"GP":
        return None
    envelope = (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]
    return None if blob[3] & 0x10 else blob[8 + envelope :]


def list_layers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each feature layer of each GeoPackage."""

    def parse(_: str, content: bytes):
        db = _open(content)
        for name, kind, srs in db.execute("SELECT g.table_name, g.geometry_type_name, g.srs_id FROM gpkg_geometry_columns g JOIN gpkg_contents c USING (table_name) WHERE c.data_type = 'features' ORDER BY 1"):
            yield name, kind, srs, [r[1] for r in db.execute(f'PRAGMA table_info("{name}")')]

    return _parsed(_files(spark, path, "*.gpkg"), parse, LISTING)


def read_gpkg(spark: SparkSession, path: str, layer: str, where: str | None = None) -> DataFrame:
    """Features of a layer that meet a condition of SQL, from the files' bytes; a file without the layer is an error."""

    def parse(name: str, content: bytes):
        db = _open(content)
        found = db.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()
        if found is None:
            raise ValueError(f"{name} has no layer {layer}")
        cur = db.execute(f'SELECT rowid, * FROM "{layer}" WHERE {where or 1}')
        names = [d[0] for d in cur.description]
        at = names.index(found[0])
        for r in cur:
            yield r[0], {n: _text(v) for i, (n, v) in enumerate(zip(names, r, strict=True)) if i not in (0, at)}, gpkg_blob(r[at])

    return _parsed(_files(spark, path, "*.gpkg"), parse, LAYER)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Polygon and multipolygon features."""

    def parse(_: str, content: bytes):
        for i, f in enumerate(json.loads(content)["features"]):
            g = f.get("geometry") or {}
            polygons = [g["coordinates"]] if g.get("type") == "Polygon" else g["coordinates"] if g.get("type") == "MultiPolygon" else []
            rings = [[np.array(r, float)[:, :2] for r in p] for p in polygons]
            yield i, {k: _text(v) for k, v in (f.get("properties") or {}).items()}, G.to_wkb(rings) if rings else None

    return _parsed(_files(spark, path, "*.geojson"), parse, LAYER)


def parse_shp(shp: bytes) -> Iterator[bytes | None]:
    """WKB of each polygon record; null shapes are null."""
    at = 100
    while at + 8 <= len(shp):
        (words,) = struct.unpack_from(">i", shp, at + 4)
        kind, body = struct.unpack_from("<i", shp, at + 8)[0], at + 12
        at += 8 + 2 * words
        if kind not in (5, 15, 25):
            yield None
            continue
        parts, points = struct.unpack_from("<ii", shp, body + 32)
        starts = [*struct.unpack_from(f"<{parts}i", shp, body + 40), points]
        xy = np.frombuffer(shp, "<f8", 2 * points, body + 40 + 4 * parts).reshape(-1, 2)
        rings = [xy[a:b] for a, b in zip(starts, starts[1:], strict=False)]
        polygons: G.Polygons = []
        for r in rings:  # outer rings run clockwise here, holes follow the ring that holds them
            if G.signed_area(r) <= 0 or not polygons:
                polygons.append([r])
            else:
                home = next((p for p in polygons if G.contains([p[:1]], *r[0])), polygons[-1])
                home.append(r)
        yield G.to_wkb(polygons)


def parse_dbf(dbf: bytes, encoding: str = "utf-8") -> Iterator[dict[str, str | None]]:
    count, head, size = struct.unpack_from("<IHH", dbf, 4)
    fields, at = [], 32
    while dbf[at] != 0x0D:
        fields.append((dbf[at : at + 11].split(b"\0")[0].decode(encoding), dbf[at + 16]))
        at += 32
    for i in range(count):
        pos = head + i * size + 1
        row = {}
        for name, width in fields:
            row[name] = dbf[pos : pos + width].decode(encoding, "replace").strip(" \0") or None
            pos += width
        yield row


def read_shapefile(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """Features of every .shp below the path with the attributes of the .dbf beside it."""
    files = _files(spark, path, "*.{shp,dbf}").withColumn("stem", F.regexp_replace("path", r"\.\w+$", ""))
    both = files.groupBy("stem").agg(F.max(F.when(F.col("path").endswith(".shp"), F.col("content"))).alias("shp"), F.max(F.when(F.col("path").endswith(".dbf"), F.col("content"))).alias("dbf")).where("shp IS NOT NULL")
    packed = both.select("stem", F.concat(F.lpad(F.length("shp").cast("string"), 12, "0").cast("binary"), "shp", F.coalesce("dbf", F.lit(b""))).alias("content"))

    def parse(_: str, content: bytes):
        n = 12 + int(content[:12])
        shapes = list(parse_shp(content[12:n]))
        attrs = list(parse_dbf(content[n:], encoding)) if len(content) > n else [{}] * len(shapes)
        for i, (g, a) in enumerate(zip(shapes, attrs, strict=True)):
            yield i, a, g

    return _parsed(packed, parse, LAYER)


def parse_tiff(raw: bytes) -> tuple[np.ndarray, float | None, tuple[float, ...]]:
    """First band, nodata value and the geotransform (x0, dx, y0, dy) of a GeoTIFF, plain or deflated, in strips or tiles."""
    o = "<" if raw[:2] == b"II" else ">"
    (at,) = struct.unpack_from(o + "I", raw, 4)
    (n,) = struct.unpack_from(o + "H", raw, at)
    sizes, tags = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 12: "d"}, {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(o + "HHI", raw, at + 2 + 12 * i)
        if kind not in sizes:
            continue
        width = struct.calcsize(o + sizes[kind]) * count
        pos = at + 2 + 12 * i + 8 if width <= 4 else struct.unpack_from(o + "I", raw, at + 2 + 12 * i + 8)[0]
        tags[tag] = raw[pos : pos + width].rstrip(b"\0") if kind == 2 else struct.unpack_from(o + f"{count}" + sizes[kind] if kind != 5 else o + f"{2 * count}I", raw, pos)
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    if one(277, 1) != 1:
        raise ValueError("only rasters of one band are read")
    if one(259, 1) not in (1, 8, 32946) or one(317, 1) != 1:
        raise ValueError("only plain and deflated rasters without a predictor are read")
    w, h = one(256), one(257)
    kind = np.dtype(o + {1: "u", 2: "i", 3: "f"}[one(339, 1)] + str(one(258, 8) // 8))
    tiled = 322 in tags
    tw, th = (one(322), one(323)) if tiled else (w, one(278, h))
    out = np.zeros((-(-h // th) * th, -(-w // tw) * tw), kind)
    for k, (start, size) in enumerate(zip(tags[324 if tiled else 273], tags[325 if tiled else 279], strict=True)):
        part = raw[start : start + size]
        block = np.frombuffer(zlib.decompress(part) if one(259, 1) != 1 else part, kind)
        r, c = divmod(k, -(-w // tw))
        rows = len(block) // tw
        out[r * th : r * th + rows, c * tw : (c + 1) * tw] = block[: rows * tw].reshape(rows, tw)
    scale, tie = tags.get(33550, (1.0, 1.0, 0.0)), tags.get(33922, (0.0,) * 6)
    nodata = float(tags[42113].decode()) if 42113 in tags else None
    return out[:h, :w], nodata, (tie[3] - tie[0] * scale[0], scale[0], tie[4] + tie[1] * scale[1], -scale[1])


def read_geotiff(spark: SparkSession, path: str) -> DataFrame:
    """path, row, col, z of every cell of the raster or its tiles, on one grid; cells without data are null."""
    corner = raster_transform(spark, path)

    def parse(_: str, content: bytes):
        z, nodata, (x0, dx, y0, dy) = parse_tiff(content)
        z = z.astype(float)
        ok = np.isfinite(z) & (z != nodata if nodata is not None else True)
        # tiles lie on one grid, whose first cell is at the corner of all
        top, left = round((y0 - corner[2]) / dy), round((x0 - corner[0]) / dx)
        for r in range(z.shape[0]):
            yield from zip([top + r] * z.shape[1], range(left, left + z.shape[1]), [v if k else None for v, k in zip(z[r].tolist(), ok[r].tolist(), strict=True)], strict=True)

    return _parsed(_files(spark, path, "*.tif*"), parse, PIXELS)


def raster_transform(spark: SparkSession, path: str) -> tuple[float, ...]:
    """x0, dx, y0, dy of the one raster at the path, or of tiles that must share their cell size: the corner of all."""

    def parse(_: str, content: bytes):
        yield parse_tiff(content)[2]

    found = _parsed(_files(spark, path, "*.tif*"), parse, "path string, x0 double, dx double, y0 double, dy double")
    r = found.agg(F.min("x0").alias("x0"), F.max("y0").alias("y0"), F.min("dx").alias("dx"), F.max("dx").alias("dx1"), F.min("dy").alias("dy"), F.max("dy").alias("dy1")).first()
    if r["dx"] != r["dx1"] or r["dy"] != r["dy1"]:
        raise ValueError("tiles of different cell sizes")
    return r["x0"], r["dx"], r["y0"], r["dy"]


def repaired(layer: DataFrame, required: bool = False) -> DataFrame:
    """The layer with valid geometry of the same land, its area, bounds and interior point; rows without area drop out, or fail if required."""
    schema = "path string, fid long, attrs map<string,string>, geometry binary, area double, x0 double, y0 double, x1 double, y1 double, px double, py double"
    ship(layer.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, cols = [], [[] for _ in range(8)]
            for i, raw in enumerate(b.column(3).to_pylist()):
                g, _ = N.make_valid(G.from_wkb(raw)) if raw else ([], False)
                if not g:
                    if required:
                        raise ValueError(f"feature {b.column(1)[i].as_py()} has no polygon")
                    continue
                keep.append(i)
                for c, v in zip(cols, (G.to_wkb(g), G.area(g), *G.bounds(g), *G.interior_point(g)), strict=True):
                    c.append(v)
            out = b.select([0, 1, 2]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cols[0], pa.binary()), *(pa.array(c, pa.float64()) for c in cols[1:])], [x.split()[0] for x in schema.replace("map<string,string>", "map").split(", ")])

    return layer.mapInArrow(run, schema)
