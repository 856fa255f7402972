"""GeoTIFF as a partitioned data source.

A partition is a run of strips or tiles of one file, which its task reads by byte
ranges and gives as Arrow arrays. Conditions on rows and columns reach the source: runs
outside are never opened. Headers, a few hundred bytes a file, are read on the driver.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from parcelspark.functions import crs as C
from parcelspark.operators.resample import Grid
from parcelspark.scratch import prepare
from parcelspark.sources import stores

SCHEMA = "path string, row long, col long, z double"
#: Cells of one partition, and of one Arrow batch.
CELLS, BATCH = 1 << 22, 1 << 18
#: TIFF field types as struct codes.
KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


class RasterError(ValueError):
    """A raster that cannot be read, or rasters that do not fit together."""


@dataclass(frozen=True)
class Header:
    """What a file says of its raster: size, blocks (height, width, bytes), type, compression, geotransform, nodata, system."""

    path: str
    rows: int
    cols: int
    block: tuple[int, int]
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    kind: str
    compression: int
    predictor: int
    transform: tuple[float, float, float, float, float, float]
    nodata: float | None
    epsg: int | None

    @property
    def across(self) -> int:
        return -(-self.cols // self.block[1])

    @property
    def grid(self) -> Grid:
        a, b, c, d, e, f = self.transform
        if abs(b) > 1e-12 or abs(d) > 1e-12:
            raise RasterError(f"{self.path}: rotated grids must be made straight first")
        return Grid(c, a, f, e, self.rows, self.cols)


def header(path: str) -> Header:
    """Of a classic or a big TIFF."""
    store, at = stores.split(path)
    with store.open_input_file(at) as f:
        head = f.read_at(16, 0)
        o = {b"II": "<", b"MM": ">"}.get(head[:2])
        if o is None:
            raise RasterError(f"{path} is not a TIFF")
        big = struct.unpack_from(o + "H", head, 2)[0] == 43
        (start,) = struct.unpack_from(o + ("Q" if big else "I"), head, 8 if big else 4)
        wide, size, word = (8, 20, "Q") if big else (2, 12, "I")
        (n,) = struct.unpack(o + ("Q" if big else "H"), f.read_at(wide, start))
        raw, tags = f.read_at(n * size, start + wide), {}
        for i in range(n):
            tag, kind = struct.unpack_from(o + "HH", raw, i * size)
            (count,) = struct.unpack_from(o + word, raw, i * size + 4)
            if kind not in KINDS:
                continue
            width = struct.calcsize(o + KINDS[kind]) * count
            slot = i * size + (12 if big else 8)
            value = raw[slot : slot + width] if width <= (8 if big else 4) else f.read_at(width, struct.unpack_from(o + word, raw, slot)[0])
            tags[tag] = value.rstrip(b"\0") if kind == 2 else struct.unpack(f"{o}{count * len(KINDS[kind])}{KINDS[kind][0]}", value)
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    if one(277, 1) != 1:
        raise RasterError(f"{path}: only rasters of one band are read")
    if one(259, 1) not in (1, 8, 32946, 50000):
        raise RasterError(f"{path}: only plain, deflated and Zstandard rasters are read")
    rows, cols, tiled = one(257), one(256), 322 in tags
    keys = tags.get(34735, ())
    known = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    code = known.get(3072) if known.get(1024) == 1 else known.get(2048)
    if 34264 in tags:
        m = tags[34264]
        transform = m[0], m[1], m[3], m[4], m[5], m[7]
    else:
        scale, tie = tags.get(33550, (1.0, 1.0, 0.0)), tags.get(33922, (0.0,) * 6)
        transform = scale[0], 0.0, tie[3] - tie[0] * scale[0], 0.0, -scale[1], tie[4] + tie[1] * scale[1]
    if known.get(1025) == 2:  # values belong to points: cells lie half a cell up and left
        transform = transform[0], transform[1], transform[2] - transform[0] / 2, transform[3], transform[4], transform[5] - transform[4] / 2
    kind = o + {1: "u", 2: "i", 3: "f"}[one(339, 1)] + str(one(258, 8) // 8)
    nodata = float(tags[42113].decode()) if tags.get(42113, b"").strip() else None
    block = (one(323), one(322)) if tiled else (min(one(278, rows), rows), cols)
    return Header(path, rows, cols, block, tags[324 if tiled else 273], tags[325 if tiled else 279], kind, one(259, 1), one(317, 1), tuple(map(float, transform)), nodata, code if code and code < 32767 else None)


def unpacked(h: Header, raw: bytes) -> np.ndarray:
    """The cells of one block (its rows, full width)."""
    if h.compression in (8, 32946):
        raw = zlib.decompress(raw)
    elif h.compression == 50000:
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=h.block[0] * h.block[1] * 8)
    kind, w = np.dtype(h.kind), h.block[1]
    if h.predictor == 3:  # bytes of one significance lie together, each the difference from the one before
        parts = np.cumsum(np.frombuffer(raw, np.uint8).reshape(-1, w * kind.itemsize), axis=1, dtype=np.uint8)
        return parts.reshape(-1, kind.itemsize, w).transpose(0, 2, 1).copy().view(kind.newbyteorder(">"))[:, :, 0]
    out = np.frombuffer(raw, kind).reshape(-1, w)
    if h.predictor == 2:
        plain = kind.newbyteorder("=")
        out = np.cumsum(out.astype(plain), axis=1, dtype=plain)
    return out


@dataclass
class Blocks(InputPartition):
    """Blocks first to last - 1 of one file."""

    head: Header
    top: int
    left: int
    first: int
    last: int


class RasterReader(DataSourceReader):
    def __init__(self, options: dict):
        self.heads = [Header(**{k: tuple(v) if isinstance(v, list) else v for k, v in h.items()}) for h in json.loads(options["headers"])]
        self.cells = int(options["cells"])
        self.low, self.high = {"row": -(1 << 62), "col": -(1 << 62)}, {"row": 1 << 62, "col": 1 << 62}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of rows and columns; Spark applies all conditions again, so whole blocks may be given."""
        for f in filters:
            name = getattr(f, "attribute", ("",))[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if name in self.low:
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low[name] = max(self.low[name], f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high[name] = min(self.high[name], f.value - isinstance(f, LessThan))
                if isinstance(f, In) and f.value:
                    self.low[name], self.high[name] = max(self.low[name], min(f.value)), min(self.high[name], max(f.value))
            yield f

    def _wanted(self, head: Header, top: int, left: int, k: int) -> bool:
        r, c = divmod(k, head.across)
        r, c = top + r * head.block[0], left + c * head.block[1]
        return r <= self.high["row"] and r + head.block[0] > self.low["row"] and c <= self.high["col"] and c + head.block[1] > self.low["col"]

    def partitions(self) -> list[Blocks]:
        x0, y0 = min(h.grid.x0 for h in self.heads), max(h.grid.y0 for h in self.heads)
        out = []
        for h in self.heads:
            g = h.grid
            top, left = round((g.y0 - y0) / g.dy), round((g.x0 - x0) / g.dx)
            run = max(1, self.cells // (h.block[0] * h.block[1]))
            for first in range(0, len(h.offsets), run):
                last = min(first + run, len(h.offsets))
                if any(self._wanted(h, top, left, k) for k in range(first, last)):
                    out.append(Blocks(h, top, left, first, last))
        return out or [Blocks(self.heads[0], 0, 0, 0, 0)]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        h = partition.head
        store, at = stores.split(h.path)
        with store.open_input_file(at) as f:
            for k in range(partition.first, partition.last):
                if not self._wanted(h, partition.top, partition.left, k) or not h.sizes[k]:
                    continue
                r, c = divmod(k, h.across)
                z = unpacked(h, f.read_at(h.sizes[k], h.offsets[k]))[: h.rows - r * h.block[0], : h.cols - c * h.block[1]]
                step = max(1, BATCH // z.shape[1])
                for i in range(0, len(z), step):
                    part = z[i : i + step].astype(np.float64)
                    none = ~np.isfinite(part) if h.nodata is None else ~np.isfinite(part) | (part == h.nodata)
                    row = np.arange(len(part)) + partition.top + r * h.block[0] + i
                    col = np.arange(part.shape[1]) + partition.left + c * h.block[1]
                    n = part.size
                    path = pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([h.path])).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([path, pa.array(np.repeat(row, len(col))), pa.array(np.tile(col, len(row))), pa.array(part.ravel(), mask=none.ravel())], ["path", "row", "col", "z"])


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "parcelspark_raster"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.options)


def headers(path: str | list[str]) -> list[Header]:
    """Of one file, of all rasters below a folder, or of several paths; they must lie on one grid in one system."""
    paths = [p for one in ([path] if isinstance(path, str) else path) for p in stores.listed(one, "*.tif*")]
    if not paths:
        raise RasterError(f"no raster at {path}")
    with ThreadPoolExecutor(16) as pool:
        found = list(pool.map(header, paths))
    if len({(h.transform[0], h.transform[4]) for h in found}) > 1:
        raise RasterError("tiles of different cell sizes")
    if len({h.epsg for h in found}) > 1:
        raise RasterError("tiles of different coordinate systems")
    return found


def mosaic_grid(found: list[Header]) -> Grid:
    grids = [h.grid for h in found]
    x0, y0, dx, dy = min(g.x0 for g in grids), max(g.y0 for g in grids), grids[0].dx, grids[0].dy
    rows = max(round((g.y0 - y0) / dy) + g.rows for g in grids)
    return Grid(x0, dx, y0, dy, rows, max(round((g.x0 - x0) / dx) + g.cols for g in grids))


def read_cells(spark: SparkSession, found: list[Header], cells: int = CELLS) -> DataFrame:
    """path, row, col, z of every cell, on the grid of all tiles; cells without data are null."""
    prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSource)
    return spark.read.format(RasterSource.name()).options(headers=json.dumps([h.__dict__ for h in found]), cells=str(cells)).load()


@dataclass(frozen=True)
class Elevation:
    """Cells (row, col, z) of an elevation model, their grid, and its coordinate system where the files name one."""

    cells: DataFrame
    grid: Grid
    crs: C.Crs | None


def _system(code: int | None) -> C.Crs | None:
    try:
        return C.from_epsg(code) if code else None
    except C.CrsError:
        return C.opaque(code)


def read_elevation(spark: SparkSession, path: str | list[str], bounds: tuple[float, float, float, float] | None = None, bounds_crs: C.Crs | None = None, margin: int = 3) -> Elevation:
    """One band, mosaicked (the first tile with data wins), cropped to bounds with a margin of cells; bounds outside are an error."""
    found = headers(path)
    grid, crs = mosaic_grid(found), _system(found[0].epsg)
    cells = read_cells(spark, found)
    if bounds is not None:
        if bounds_crs is not None and crs is not None and not bounds_crs.same(crs):
            edge = np.linspace(0, 1, 21)
            side = lambda lo, hi: lo + edge * (hi - lo)
            x0, y0, x1, y1 = bounds
            x, y = C.between(bounds_crs, crs)(np.concatenate([side(x0, x1), side(x0, x1), np.full(21, x0), np.full(21, x1)]), np.concatenate([np.full(21, y0), np.full(21, y1), side(y0, y1), side(y0, y1)]))
            bounds = float(x.min()), float(y.min()), float(x.max()), float(y.max())
        left, right = (int(np.floor((x - grid.x0) / grid.dx)) for x in (bounds[0], bounds[2]))
        top, bottom = (int(np.floor((y - grid.y0) / grid.dy)) for y in (bounds[3], bounds[1]))
        if right + margin < 0 or left - margin >= grid.cols or bottom + margin < 0 or top - margin >= grid.rows:
            raise RasterError(f"the elevation does not overlap the parcels, whose bounds in its system are {bounds}")
        cells = cells.where(F.col("row").between(top - margin, bottom + margin) & F.col("col").between(left - margin, right + margin))
    if len(found) > 1:
        cells = cells.groupBy("row", "col").agg(F.min_by("z", F.struct(F.isnull("z"), "path")).alias("z"))
    return Elevation(cells.select("row", "col", "z"), grid, crs)


def placeholder(bounds: tuple[float, float, float, float], epsg: int) -> bytes:
    """A GeoTIFF of one cell of elevation 0 over bounds, for a run whose slopes come from the parcels' own attribute."""
    x0, y0, x1, y1 = bounds
    if not (x1 > x0 and y1 > y0):
        raise RasterError("no extent for a placeholder")
    cell = zlib.compress(struct.pack("<f", 0.0))
    geographic = epsg < 32767 and _system(epsg).geographic
    keys = [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg]
    nodata = b"-9999\0"
    tags = [(256, "H", [1]), (257, "H", [1]), (258, "H", [32]), (259, "H", [8]), (262, "H", [1]), (273, "I", [8]), (277, "H", [1]), (278, "H", [1]), (279, "I", [len(cell)]), (339, "H", [3]), (33550, "d", [x1 - x0, y1 - y0, 0.0]), (33922, "d", [0.0, 0.0, 0.0, x0, y1, 0.0]), (34735, "H", keys), (42113, "s", nodata)]
    at = 8 + len(cell) + len(cell) % 2
    entries, extra, beyond = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        raw = values if kind == "s" else struct.pack(f"<{len(values)}{kind}", *values)
        entries += struct.pack("<HHI", tag, {"H": 3, "I": 4, "d": 12, "s": 2}[kind], len(values))
        if len(raw) > 4:
            entries += struct.pack("<I", beyond + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            entries += raw.ljust(4, b"\0")
    return struct.pack("<2sHI", b"II", 42, at) + cell.ljust(at - 8, b"\0") + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + extra
