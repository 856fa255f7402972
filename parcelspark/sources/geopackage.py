"""GeoPackage layers as a partitioned data source.

A partition is a range of row numbers of one file, which its task reads from the file
itself; a condition on attributes and a box (through the file's own R-tree) are
answered inside the file, so features that are not asked for never leave it. The file
must be on a file system that driver and tasks mount; elsewhere Spark reads its bytes
whole (`files.read_gpkg`), and the condition is applied to each.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from parcelspark.functions import crs as C
from parcelspark.functions import geometry as G
from parcelspark.functions import noding as N
from parcelspark.scratch import prepare
from parcelspark.sources import files, stores

#: Features of one partition, and of one Arrow batch.
FEATURES, BATCH = 50_000, 2048


class LayerReadError(ValueError):
    """A layer that is missing, has no features or no coordinate system."""


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.replace('%', '%25').replace('?', '%3f').replace('#', '%23')}?mode=ro&immutable=1", uri=True)


def described(db: sqlite3.Connection, path: str, layer: str) -> tuple[str, C.Crs | None]:
    """Geometry column and coordinate system of a layer."""
    found = db.execute("SELECT column_name, srs_id FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()
    if found is None:
        raise LayerReadError(f"{path} has no layer {layer}")
    srs = db.execute("SELECT organization, organization_coordsys_id, definition FROM gpkg_spatial_ref_sys WHERE srs_id = ?", (found[1],)).fetchone()
    if srs is None or srs[1] in (-1, 0) or srs[0].upper() == "NONE":
        return found[0], None
    for read in (lambda: C.from_epsg(srs[1]) if srs[0].upper() == "EPSG" else C.from_wkt(srs[2]), lambda: C.from_wkt(srs[2])):
        try:
            return found[0], read()
        except C.CrsError:
            continue
    return found[0], C.opaque(srs[1])


def _condition(db: sqlite3.Connection, layer: str, column: str, where: str | None, box: tuple | None) -> tuple[str, list]:
    parts, values = [f"({where})"] if where else [], []
    if box is not None:
        tree = f"rtree_{layer}_{column}"
        if db.execute("SELECT 1 FROM sqlite_master WHERE name = ?", (tree,)).fetchone():
            parts.append(f'rowid IN (SELECT id FROM "{tree}" WHERE maxx >= ? AND minx <= ? AND maxy >= ? AND miny <= ?)')
            values += [box[0], box[2], box[1], box[3]]
    return " AND ".join(parts) or "1", values


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    last: int


class LayerReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["paths"].split("\n")
        self.layer, self.where = options["layer"], options.get("where") or None
        self.box = tuple(map(float, options["box"].split(","))) if options.get("box") else None
        self.size = int(options.get("features", FEATURES))

    def partitions(self) -> list[Rows]:
        out = []
        for path in self.paths:
            db = connect(path)
            first, last = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.layer}"').fetchone()
            db.close()
            if first is not None:
                out += [Rows(path, i, min(i + self.size - 1, last)) for i in range(first, last + 1, self.size)]
        return out or [Rows(self.paths[0], 0, -1)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        db = connect(partition.path)
        column, _ = described(db, partition.path, self.layer)
        text, values = _condition(db, self.layer, column, self.where, self.box)
        cur = db.execute(f'SELECT rowid, * FROM "{self.layer}" WHERE rowid BETWEEN ? AND ? AND {text}', [partition.first, partition.last, *values])
        names = [d[0] for d in cur.description]
        at = names.index(column)
        keep = [i for i in range(1, len(names)) if i != at]
        while rows := cur.fetchmany(BATCH):
            attrs = [[(names[i], None if r[i] is None else str(r[i])) for i in keep] for r in rows]
            cols = [pa.array([partition.path] * len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array(attrs, pa.map_(pa.string(), pa.string())), pa.array([files.gpkg_blob(r[at]) for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["path", "fid", "attrs", "geometry"])


class LayerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "parcelspark_gpkg"

    def schema(self) -> str:
        return files.LAYER

    def reader(self, schema) -> LayerReader:
        return LayerReader(self.options)


def read_layer(spark: SparkSession, path: str, layer: str, where: str | None = None, box: tuple[float, float, float, float] | None = None, features: int = FEATURES) -> DataFrame:
    """path, fid, attrs, geometry of the features of a layer that meet a condition of SQL and, where the file has an R-tree, a box."""
    paths = [stores.local(p) for p in stores.listed(path, "*.gpkg")] if stores.reachable(path) else []
    if not paths or None in paths:
        return files.read_gpkg(spark, path, layer, where)
    for p in paths:
        db = connect(p)
        described(db, p, layer)
        db.close()
    prepare(spark)
    spark.dataSource.register(LayerSource)
    given = {"paths": "\n".join(paths), "layer": layer, "where": where or "", "box": ",".join(map(repr, box)) if box else "", "features": str(features)}
    return spark.read.format(LayerSource.name()).options(**given).load()


def layer_crs(path: str, layer: str) -> C.Crs:
    """The coordinate system of a layer; without one it cannot be placed."""
    for p in stores.listed(path, "*.gpkg"):
        db = connect(stores.local(p) or p)
        found = described(db, p, layer)[1]
        db.close()
        if found is None:
            raise LayerReadError(f"layer {layer} of {p} has no coordinate system")
        return found
    raise LayerReadError(f"no GeoPackage at {path}")


def read_polygon_layer(spark: SparkSession, path: str, layer: str, required: bool, where: str | None = None, box: tuple | None = None) -> tuple[DataFrame, Observation]:
    """Valid polygons of a layer (as `files.repaired`), and what an action over them counts on the way.

    The counts are source_feature_count, invalid_geometry_repaired and
    empty_or_non_polygon_dropped; no feature is read twice for them. required: features
    without a polygon are an error instead of being dropped.
    """
    if stores.reachable(path) and stores.local(path):
        layer_crs(path, layer)
    raw = read_layer(spark, path, layer, where, box)
    if raw.isEmpty():
        raise LayerReadError(f"layer {layer} has no features: {path}")
    prepare(spark)
    schema = files.LAYER + ", area double, x0 double, y0 double, x1 double, y1 double, px double, py double, repaired boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for fid, blob in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                g, changed = N.make_valid(G.from_wkb(blob)) if blob else ([], False)
                if not g and required:
                    raise LayerReadError(f"feature {fid} of layer {layer} has no polygon")
                rows.append((G.to_wkb(g), G.area(g), *G.bounds(g), *G.interior_point(g), changed) if g else (None,) * 8 + (changed,))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.binary(), *[pa.float64()] * 7, pa.bool_()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["path", "fid", "attrs", "geometry", "area", "x0", "y0", "x1", "y1", "px", "py", "repaired"])

    seen = Observation()
    checked = raw.mapInArrow(run, schema).observe(seen, F.count(F.lit(1)).alias("source_feature_count"), F.count_if("repaired").alias("invalid_geometry_repaired"), F.count_if(F.isnull("geometry")).alias("empty_or_non_polygon_dropped"))
    return checked.where("geometry IS NOT NULL").drop("repaired"), seen
