"""Rasters on other grids: every target cell gathers its neighbours from one source tile.

Source cells go to square tiles with a border as wide as the kernel, so whatever a
target cell needs lies in the tile of the source cell that holds its centre. Tiles of
the target are made where they are used, from their number alone; a pair of target and
source tile carries one array, and nothing is exchanged after it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.functions import crs as C
from parcelspark.functions import geometry as G
from parcelspark.operators import polygons
from parcelspark.scratch import prepare

METHODS = ("nearest", "bilinear", "cubic")
TILE, HALO = 256, 2


@dataclass(frozen=True)
class Grid:
    """x of the left edge, width of a cell, y of the upper edge, height of a cell (negative: downwards), rows and columns."""

    x0: float
    dx: float
    y0: float
    dy: float
    rows: int
    cols: int


def tiles(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """tr, tc and z (bytes of doubles) of each tile with its border; pixels: row, col, z (null: no data)."""
    prepare(pixels.sparkSession)
    near = lambda c: F.explode(F.array_distinct(F.array(F.floor((F.col(c) - HALO) / tile), F.floor((F.col(c) + HALO) / tile))))
    dealt = pixels.where("z IS NOT NULL").select(F.col("row").cast("long"), F.col("col").cast("long"), F.col("z").cast("double"), near("row").alias("tr")).withColumn("tc", near("col"))
    side = tile + 2 * HALO

    def run(cells: pa.Table) -> pa.Table:
        top, left = cells["tr"][0].as_py() * tile - HALO, cells["tc"][0].as_py() * tile - HALO
        z = np.full((side, side), np.nan)
        z[cells["row"].to_numpy() - top, cells["col"].to_numpy() - left] = cells["z"].to_numpy()
        return pa.table([cells["tr"][:1], cells["tc"][:1], pa.array([z.astype("<f8").tobytes()], pa.binary())], names=["tr", "tc", "z"])

    return dealt.groupBy("tr", "tc").applyInArrow(run, "tr long, tc long, z binary")


def kernel(z: np.ndarray, u: np.ndarray, v: np.ndarray, method: str) -> np.ndarray:
    """Values at fractional columns u and rows v of an array (cell k spans k to k + 1); what has no data there is nan.

    Bilinear weights are shared among the neighbours with data; a cubic kernel that meets
    a cell without data is bilinear.
    """
    if method == "nearest":
        return z[np.floor(v).astype(int), np.floor(u).astype(int)]
    j, i = np.floor(u - 0.5).astype(int), np.floor(v - 0.5).astype(int)
    fx, fy = u - 0.5 - j, v - 0.5 - i
    total, weight = np.zeros(len(u)), np.zeros(len(u))
    for a, wy in ((0, 1 - fy), (1, fy)):
        for b, wx in ((0, 1 - fx), (1, fx)):
            near = z[i + a, j + b]
            w = np.where(np.isnan(near), 0, wx * wy)
            total += w * np.nan_to_num(near)
            weight += w
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.where(weight > 1e-6, total / weight, np.nan)
    if method == "cubic":
        total = np.zeros(len(u))
        for a, wy in enumerate(_catmull(fy), -1):
            for b, wx in enumerate(_catmull(fx), -1):
                total += wx * wy * z[i + a, j + b]
        out = np.where(np.isnan(total), out, total)
    return out


def _catmull(t: np.ndarray) -> tuple[np.ndarray, ...]:
    """Weights of four neighbours by the cubic convolution with parameter -1/2."""
    return ((-t + 2 * t**2 - t**3) / 2, (2 - 5 * t**2 + 3 * t**3) / 2, (t + 4 * t**2 - 3 * t**3) / 2, (t**3 - t**2) / 2)


def resample(pixels: DataFrame, source: Grid, target: Grid, method: str = "bilinear", back: C.Transform | None = None, tile: int = TILE) -> DataFrame:
    """row, col, z of the target's cells whose centre the source holds; back: target positions to source positions."""
    if method not in METHODS:
        raise ValueError(f"no resampling by {method}")
    spark = pixels.sparkSession
    side, across = tile + 2 * HALO, -(-target.cols // tile)

    def places(t: int) -> tuple[np.ndarray, ...]:
        """Rows and columns of a target tile's cells whose centre the source holds, and where they lie in it."""
        r0, c0 = t // across * tile, t % across * tile
        row, col = (x.ravel() for x in np.meshgrid(np.arange(r0, min(r0 + tile, target.rows)), np.arange(c0, min(c0 + tile, target.cols)), indexing="ij"))
        x, y = target.x0 + (col + 0.5) * target.dx, target.y0 + (row + 0.5) * target.dy
        x, y = back(x, y) if back else (x, y)
        u, v = (x - source.x0) / source.dx, (y - source.y0) / source.dy
        m = (u >= 0) & (u < source.cols) & (v >= 0) & (v < source.rows)
        return row[m], col[m], u[m], v[m]

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                _, _, u, v = places(t)
                both = np.unique(np.stack([v // tile, u // tile], 1).astype(np.int64), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(both), t)), pa.array(both[:, 0]), pa.array(both[:, 1])], ["t", "tr", "tc"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, tr, tc, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                row, col, u, v = places(t)
                m = (v // tile == tr) & (u // tile == tc)
                z = kernel(np.frombuffer(raw, "<f8").reshape(side, side), u[m] - tc * tile + HALO, v[m] - tr * tile + HALO, method)
                yield pa.RecordBatch.from_arrays([pa.array(row[m].astype(np.int64)), pa.array(col[m].astype(np.int64)), pa.array(z, mask=np.isnan(z))], ["row", "col", "z"])

    prepare(spark)
    wanted = spark.range(-(-target.rows // tile) * across).mapInArrow(needs, "t long, tr long, tc long")
    pairs = wanted.join(tiles(pixels, tile), ["tr", "tc"]).select("t", "tr", "tc", "z")
    return pairs.mapInArrow(gather, "row long, col long, z double")


def fitted(source: Grid, forth: C.Transform) -> Grid:
    """The grid of square cells over the source's outline in another system, with as many cells along its diagonal."""
    edge = np.linspace(0, 1, 22)
    u = np.concatenate([edge, edge, np.zeros(22), np.ones(22)]) * source.cols
    v = np.concatenate([np.zeros(22), np.ones(22), edge, edge]) * source.rows
    x, y = forth(source.x0 + u * source.dx, source.y0 + v * source.dy)
    x0, x1, y0, y1 = float(x.min()), float(x.max()), float(y.min()), float(y.max())
    size = math.hypot(x1 - x0, y1 - y0) / math.hypot(source.rows, source.cols)
    return Grid(x0, size, y1, -size, max(1, math.ceil((y1 - y0) / size - 1e-9)), max(1, math.ceil((x1 - x0) / size - 1e-9)))


def reproject(pixels: DataFrame, source: Grid, a: C.Crs, b: C.Crs, method: str = "bilinear") -> tuple[DataFrame, Grid]:
    """The raster in another coordinate system, and its grid; the same system leaves it as it is."""
    if a.same(b):
        return pixels.select("row", "col", "z"), source
    target = fitted(source, C.between(a, b))
    return resample(pixels, source, target, method, C.between(b, a)), target


def moved(shapes: DataFrame, key: str, a: C.Crs, b: C.Crs) -> DataFrame:
    """key, geometry: polygons with the vertices of system a in system b."""
    own = shapes.select(key, "geometry")
    if a.same(b):
        return own
    change, kind = C.between(a, b), dict(shapes.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [G.to_wkb([[np.stack(change(r[:, 0], r[:, 1]), 1) for r in p] for p in G.from_wkb(raw)]) if raw else None for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [key, "geometry"])

    prepare(shapes.sparkSession)
    return own.mapInArrow(run, f"{key} {kind}, geometry binary")


def index_cell(grid: Grid) -> float:
    """A side for the cells of an index over a raster: a power of two of about sixteen of its cells."""
    return 2.0 ** math.ceil(math.log2(16 * max(abs(grid.dx), abs(grid.dy))))


def zonal_in_raster_crs(shapes: DataFrame, key: str, a: C.Crs, pixels: DataFrame, grid: Grid, b: C.Crs) -> DataFrame:
    """key, mean, max, n of the cells whose centre a polygon holds; polygons in system a, the raster in b."""
    centre = pixels.where("z IS NOT NULL").select("row", "col", "z", (F.lit(grid.x0) + (F.col("col") + 0.5) * grid.dx).alias("px"), (F.lit(grid.y0) + (F.col("row") + 0.5) * grid.dy).alias("py"))
    return polygons.zonal(centre, moved(shapes, key, a, b), key, index_cell(grid))
