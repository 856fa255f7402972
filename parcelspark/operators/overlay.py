"""Overlay joins of boxes through grid cells.

A box inequality join would be a nested loop, so boxes are spread over grid cells
and joined on equal cells; a pair that shares several cells is kept in the cell
that holds the lower left corner of its intersection, which needs no distinct.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.scratch import ship


def cells(df: DataFrame, size: int, x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1") -> DataFrame:
    """One row for each grid cell that a box touches: cx, cy."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))
    return df.withColumn("cx", F.explode(span(x0, x1))).withColumn("cy", F.explode(span(y0, y1)))


def overlap_area(a: str, b: str) -> Column:
    c = lambda s, n: F.col(f"{s}.{n}")
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(c(a, hi), c(b, hi)) - F.greatest(c(a, lo), c(b, lo)))
    return side("x0", "x1") * side("y0", "y1")


def box_pairs(left: DataFrame, right: DataFrame, size: int = 200) -> DataFrame:
    """Pairs of boxes (aliases l and r) with a positive intersection, each once, with its area."""
    a, b = cells(left, size).alias("l"), cells(right, size).alias("r")
    home = (F.floor(F.greatest(F.col("l.x0"), F.col("r.x0")) / size) == F.col("l.cx")) & (F.floor(F.greatest(F.col("l.y0"), F.col("r.y0")) / size) == F.col("l.cy"))
    return a.join(b, (F.col("l.cx") == F.col("r.cx")) & (F.col("l.cy") == F.col("r.cy"))).where(home).withColumn("area", overlap_area("l", "r")).where("area > 0")


def dominant_overlap(parcels: DataFrame, zones: DataFrame, size: int = 200) -> DataFrame:
    """bsm, zone_id, pdjb, area of the zone that covers most of each parcel; equal areas go to the smaller zone."""
    pairs = box_pairs(parcels.select("bsm", "x0", "y0", "x1", "y1"), zones, size)
    best = pairs.groupBy("l.bsm").agg(F.max(F.struct("area", (-F.col("r.zone_id")).alias("z"), F.col("r.pdjb").alias("pdjb"))).alias("b"))
    return best.select("bsm", (-F.col("b.z")).alias("zone_id"), F.col("b.pdjb").alias("pdjb"), F.col("b.area").alias("area"))


def dissolved_overlap(parcels: DataFrame, zones: DataFrame, cell: int = 1, size: int = 200) -> DataFrame:
    """bsm, area of each parcel that any zone covers, counting land under several zones once.

    A parcel's zones cut it into slabs between their vertical edges; in each slab the
    covered height is the length of the union of the zones' vertical ranges.
    """
    pairs = box_pairs(parcels.select("bsm", "x0", "y0", "x1", "y1"), zones, size)
    clip = F.struct(F.greatest("l.x0", "r.x0").alias("x0"), F.least("l.x1", "r.x1").alias("x1"), F.greatest("l.y0", "r.y0").alias("y0"), F.least("l.y1", "r.y1").alias("y1"))
    boxes = pairs.select(F.col("l.bsm").alias("bsm"), clip.alias("c")).groupBy("bsm").agg(F.sort_array(F.collect_list("c")).alias("boxes"))
    xs = F.array_sort(F.array_distinct(F.concat(F.transform("boxes", lambda c: c["x0"]), F.transform("boxes", lambda c: c["x1"]))))
    spans = F.zip_with("xs", F.slice("xs", 2, F.size("xs")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    start = F.struct(F.lit(0.0).cast("double").alias("len"), F.lit(-1e300).alias("top"))

    def height(a: Column, b: Column) -> Column:
        ranges = F.array_sort(F.transform(F.filter("boxes", lambda c: (c["x0"] <= a) & (c["x1"] >= b)), lambda c: F.struct(c["y0"].alias("lo"), c["y1"].alias("hi"))))
        return F.aggregate(ranges, start, lambda s, r: F.struct((s["len"] + F.greatest(F.lit(0.0), r["hi"] - F.greatest(r["lo"], s["top"]))).alias("len"), F.greatest(s["top"], r["hi"]).alias("top")), lambda s: s["len"])

    slabs = F.filter(F.col("spans"), lambda s: s["b"].isNotNull())
    total = F.aggregate(slabs, F.lit(0.0).cast("double"), lambda t, s: t + (s["b"] - s["a"]) * height(s["a"], s["b"]))
    return boxes.withColumn("xs", xs).withColumn("spans", spans).select("bsm", total.alias("area"))


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: int = 200, within: bool = False) -> DataFrame:
    """Pairs (aliases p and b) of points (px, py) and the boxes that hold them, upper edges excluded; within: all edges."""
    p = points.withColumns({"cx": F.floor(F.col("px") / size), "cy": F.floor(F.col("py") / size)}).alias("p")
    b = cells(boxes, size).alias("b")
    inside = (F.col("px") >= F.col("b.x0")) & (F.col("px") < F.col("b.x1")) & (F.col("py") >= F.col("b.y0")) & (F.col("py") < F.col("b.y1"))
    if within:
        inside = inside & (F.col("px") > F.col("b.x0")) & (F.col("py") > F.col("b.y0"))
    return p.join(b, (F.col("p.cx") == F.col("b.cx")) & (F.col("p.cy") == F.col("b.cy"))).where(inside)


def zonal_stats(pixels: DataFrame, zones: DataFrame, pixel_size: float) -> DataFrame:
    """zone_id, mean, max and count of the cells whose centre it holds; of several zones the largest id takes the cell."""
    centre = pixels.where("z > 0").select("row", "col", "z", ((F.col("col") + 0.5) * pixel_size).alias("px"), ((F.col("row") + 0.5) * pixel_size).alias("py"))
    burnt = points_in_boxes(centre, zones).groupBy("p.row", "p.col").agg(F.max("b.zone_id").alias("zone_id"), F.first("p.z").alias("z"))
    return burnt.groupBy("zone_id").agg(F.avg("z").alias("mean"), F.max("z").alias("max"), F.count("*").alias("n"))


def nearest_pixel(points: DataFrame, pixels: DataFrame, radius: int = 2, valid: str = "z IS NOT NULL") -> DataFrame:
    """key, z of the nearest valid cell within the radius (rows first, then columns, of equals); points: key, row, col."""
    near = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    probe = points.withColumn("dr", near).withColumn("dc", near).select("key", (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), (F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).alias("d2"))
    found = probe.join(pixels.where(valid), ["row", "col"])
    return found.groupBy("key").agg(F.min(F.struct("d2", "row", "col", "z")).alias("b")).select("key", "b.z", "b.d2")


#: Cells along one side of a tile.
TILE = 256


def _by_tiles(pixels: DataFrame, kernel: Callable[[np.ndarray, int, int, tuple[int, int, int, int]], np.ndarray], tile: int) -> DataFrame:
    """row, col, slope by a kernel over square tiles with a border of one cell (z, its first row and column, the raster's ends).

    Cells go to their tile, those at a tile's border also to the tiles beside it, so an
    exchange carries little more than each cell once; a tile is one array.
    """
    ends = tuple(pixels.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first())  # one row
    near = lambda c: F.explode(F.array_distinct(F.array(F.floor((F.col(c) - 1) / tile), F.floor((F.col(c) + 1) / tile))))
    dealt = pixels.select(F.col("row").cast("long"), F.col("col").cast("long"), F.col("z").cast("double"), near("row").alias("tr")).withColumn("tc", near("col"))
    ship(pixels.sparkSession)

    def run(cells: pa.Table) -> pa.Table:
        top, left = cells["tr"][0].as_py() * tile - 1, cells["tc"][0].as_py() * tile - 1
        z = np.full((tile + 2, tile + 2), np.nan)
        value = cells["z"].to_numpy(zero_copy_only=False)
        row, col = cells["row"].to_numpy(), cells["col"].to_numpy()
        z[row - top, col - left] = np.where(value > 0, value, np.nan)
        slope = kernel(z, top, left, ends)
        own = (row > top) & (row <= top + tile) & (col > left) & (col <= left + tile)
        found = slope[row[own] - top - 1, col[own] - left - 1]
        return pa.table([row[own], col[own], pa.array(found, mask=np.isnan(found))], names=["row", "col", "slope"])

    return dealt.groupBy("tr", "tc").applyInArrow(run, "row long, col long, slope double")


def horn_slope(pixels: DataFrame, cell: float | tuple[float, float], strict_centre: bool, tile: int = TILE) -> DataFrame:
    """row, col, slope in degrees by the 3 x 3 Horn formula; outside cells repeat the edge, cells without data give null.

    cell: its side, or width and height. strict_centre: a cell without data has no slope
    even if its neighbours have.
    """
    wide, high = cell if isinstance(cell, tuple) else (cell, cell)

    def kernel(z: np.ndarray, top: int, left: int, ends: tuple[int, int, int, int]) -> np.ndarray:
        # the edge of the grid stands in for what is outside
        rows = np.clip(np.arange(top, top + tile + 2), *ends[:2]) - top
        cols = np.clip(np.arange(left, left + tile + 2), *ends[2:]) - left
        z = z[np.clip(rows, 0, tile + 1)][:, np.clip(cols, 0, tile + 1)]
        part = lambda dr, dc: z[1 + dr : tile + 1 + dr, 1 + dc : tile + 1 + dc]
        gx = sum(w * (part(d, 1) - part(d, -1)) for d, w in ((-1, 1), (0, 2), (1, 1)))
        gy = sum(w * (part(1, d) - part(-1, d)) for d, w in ((-1, 1), (0, 2), (1, 1)))
        slope = np.degrees(np.arctan(np.hypot(gx / (8 * wide), gy / (8 * high))))
        return np.where(np.isnan(part(0, 0)), np.nan, slope) if strict_centre else slope

    return _by_tiles(pixels, kernel, tile)


def gradient_slope(pixels: DataFrame, dx: float, dy: float, tile: int = TILE) -> DataFrame:
    """row, col, slope by central differences, one-sided at the ends of the raster; null next to missing cells.

    A missing cell between cells with data has a slope, as its own value takes no part.
    """

    def kernel(z: np.ndarray, top: int, left: int, ends: tuple[int, int, int, int]) -> np.ndarray:
        part = lambda dr, dc: z[1 + dr : tile + 1 + dr, 1 + dc : tile + 1 + dc]
        here, row, col = part(0, 0), np.arange(top + 1, top + tile + 1)[:, None], np.arange(left + 1, left + tile + 1)[None, :]

        def along(before: np.ndarray, after: np.ndarray, at: np.ndarray, lo: int, hi: int, step: float) -> np.ndarray:
            return np.where(at == lo, (after - here) / step, np.where(at == hi, (here - before) / step, (after - before) / (2 * step)))

        gx, gy = along(part(0, -1), part(0, 1), col, *ends[2:], dx), along(part(-1, 0), part(1, 0), row, *ends[:2], dy)
        return np.degrees(np.arctan(np.hypot(gx, gy)))

    return _by_tiles(pixels, kernel, tile)
