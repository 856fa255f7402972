"""Authority fusion: parcels with slope, slope-class, protection overlaps, locks and review flags.

Geometry is WKB in a metric CRS. Parcels and zones meet as their parts in grid cells
(`cellindex`), so a pair reads the outlines of one cell only; a cell size that is a power
of two keeps cell numbers exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.functions import codes
from parcelspark.functions import geometry as G
from parcelspark.operators import cellindex, polygons
from parcelspark.operators.overlay import nearest_pixel
from parcelspark.scratch import ship, stash

#: Columns that fusion adds, in order.
ADDED = "category slope_mean slope_max slope_pixel_count slope_assignment AREA_M2 PDT_PDJB PDT_BZPDJB PDT_OV_PCT PDT_GRADE DEM_GRADE GRD_MATCH ECO_OV_M2 ECO_PCT PBF_OV_M2 PBF_PCT LOCK_C2F LOCK_F2C EXCH_LOCK LOCK_RSN REVIEW_REQ REVIEW_RSN".split()


def boxed(df: DataFrame, key: str) -> DataFrame:
    """key, geometry, area and bounds of each row with a polygon."""
    ship(df.sparkSession)
    names = [key, "geometry", "area", "x0", "y0", "x1", "y1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                g = G.repair(G.from_wkb(raw)) if raw else []
                if g:
                    rows.append((k, G.to_wkb(g), G.area(g), *G.bounds(g)))
            if rows:
                kinds = [b.schema.field(0).type, pa.binary(), *[pa.float64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    kind = dict(df.dtypes)[key]
    return df.select(key, "geometry").mapInArrow(run, f"{key} {kind}, geometry binary, area double, x0 double, y0 double, x1 double, y1 double")


def dominant(parcels: DataFrame, zones: DataFrame, attrs: list[str], size: float) -> DataFrame:
    """bsm, attributes and area of the zone with the largest overlap; equal areas go to the smaller zone_id."""
    pieces = stash(cellindex.piece_index(zones, "zone_id", size), "zone-pieces")
    own = cellindex.near(parcels, "bsm", cellindex.extent(pieces))
    area = cellindex.overlaps(cellindex.piece_index(own, "bsm", size), pieces, "bsm", "zone_id")
    best = area.groupBy("bsm").agg(F.max(F.struct("area", (-F.col("zone_id")).alias("z"))).alias("b")).select("bsm", (-F.col("b.z")).alias("zone_id"), F.col("b.area").alias("ov"))
    return best.join(zones.select("zone_id", *attrs), "zone_id").drop("zone_id")


def dissolved(parcels: DataFrame, zones: DataFrame, size: float, name: str) -> DataFrame:
    """bsm, name: area that any zone covers."""
    pieces = stash(cellindex.piece_index(zones, "zone_id", size), "zone-pieces")
    own = cellindex.near(parcels, "bsm", cellindex.extent(pieces))
    area = cellindex.covered(cellindex.piece_index(own, "bsm", size), pieces, "bsm", "zone_id")
    return area.withColumnRenamed("area", name)


def fuse(parcels: DataFrame, slope: DataFrame, pdt: DataFrame, eco: DataFrame, pbf: DataFrame, threshold: float = 1.0, cell: float = 512.0) -> DataFrame:
    """parcels (bsm, dlbm, ..., geometry) with the columns in ADDED.

    slope: bsm, slope_mean, slope_max, slope_pixel_count, slope_assignment.
    pdt: zone_id, pdjb, bzpdjb, geometry; eco and pbf: zone_id, geometry.
    """
    box = boxed(parcels, "bsm")
    out = parcels.join(box.select("bsm", F.col("area").alias("AREA_M2")), "bsm").join(slope, "bsm", "left")
    out = out.join(dominant(box, pdt, ["pdjb", "bzpdjb"], cell), "bsm", "left")
    out = out.join(dissolved(box, eco, cell, "ECO_OV_M2"), "bsm", "left").join(dissolved(box, pbf, cell, "PBF_OV_M2"), "bsm", "left")
    out = out.fillna(0.0, ["ECO_OV_M2", "PBF_OV_M2", "ov"])
    e, p, area = F.col("ECO_OV_M2"), F.col("PBF_OV_M2"), F.col("AREA_M2")
    kind = codes.fusion_category(codes.normalise_land_use_code(F.col("dlbm")))
    lock, review = codes.lock_flag(e, p, threshold), codes.review_reason(e, p, kind, threshold)
    grade = F.coalesce(codes.grade_from_value(F.col("pdjb")), codes.grade_from_value(F.col("bzpdjb")), F.lit(-1))
    steep = codes.slope_grade(F.when(~F.isnan("slope_mean"), F.col("slope_mean")))
    added = {"category": kind, "PDT_PDJB": F.col("pdjb").cast("string"), "PDT_BZPDJB": F.col("bzpdjb"), "PDT_OV_PCT": codes.overlap_pct(F.col("ov"), area), "PDT_GRADE": grade.cast("byte"), "DEM_GRADE": steep.cast("byte"), "GRD_MATCH": codes.grade_match(grade, steep).cast("byte"), "ECO_PCT": codes.overlap_pct(e, area), "PBF_PCT": codes.overlap_pct(p, area)}
    added |= {"LOCK_C2F": lock, "LOCK_F2C": lock, "EXCH_LOCK": lock, "LOCK_RSN": codes.lock_reason(e, p, threshold), "REVIEW_REQ": (review != "").cast("int"), "REVIEW_RSN": review}
    return out.withColumns(added).select(*parcels.columns, *ADDED)


def fuse_without_zones(parcels: DataFrame, slope: DataFrame) -> DataFrame:
    """The same columns from parcels and elevation alone: neutral constraints, marked as not evaluated."""
    out = parcels.join(boxed(parcels, "bsm").select("bsm", F.col("area").alias("AREA_M2")), "bsm").join(slope, "bsm", "left")
    zero, none = F.lit(0.0), F.lit(None).cast("string")
    steep = codes.slope_grade(F.when(~F.isnan("slope_mean"), F.col("slope_mean"))).cast("byte")
    neutral = {"PDT_PDJB": none, "PDT_BZPDJB": none, "PDT_OV_PCT": zero, "PDT_GRADE": F.lit(-1).cast("byte"), "DEM_GRADE": steep, "GRD_MATCH": F.lit(-1).cast("byte"), "ECO_OV_M2": zero, "ECO_PCT": zero, "PBF_OV_M2": zero, "PBF_PCT": zero}
    neutral |= {k: F.lit(0) for k in ("LOCK_C2F", "LOCK_F2C", "EXCH_LOCK", "REVIEW_REQ")} | {"LOCK_RSN": F.lit(""), "REVIEW_RSN": F.lit("")}
    kind = codes.fusion_category(codes.normalise_land_use_code(F.col("dlbm")))
    return out.withColumns({"category": kind, **neutral}).select(*parcels.columns, *ADDED, F.lit("NOT_EVALUATED").alias("CONSTR_STA"))


def polygon_slope(parcels: DataFrame, pixels: DataFrame, pixel_size: float | tuple[float, float], origin: tuple[float, float], radius: int = 2, cell: float | None = None) -> DataFrame:
    """Slope statistics of the cells whose centre a parcel holds; else the nearest cell to its interior point; else null.

    pixels: row, col, z (the slope; null without data); the row axis points down from the
    origin. pixel_size: a side, or width and height; parcels lie in the raster's system.
    """
    x0, y0 = origin
    wide, high = pixel_size if isinstance(pixel_size, tuple) else (pixel_size, pixel_size)
    cell = cell or 2.0 ** math.ceil(math.log2(16 * max(wide, high)))
    own = boxed(parcels, "bsm")
    kind = dict(own.dtypes)["bsm"]
    centre = pixels.where("z IS NOT NULL").select("row", "col", "z", (x0 + (F.col("col") + 0.5) * wide).alias("px"), (y0 - (F.col("row") + 0.5) * high).alias("py"))
    stats = polygons.zonal(centre, parcels, "bsm", cell).selectExpr("bsm", "mean AS slope_mean", "max AS slope_max", "n AS slope_pixel_count")

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xy = [G.interior_point(G.from_wkb(g)) for g in b.column(1).to_pylist()]
            row = pa.array([int((y0 - y) // high) for _, y in xy], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), row, pa.array([int((x - x0) // wide) for x, _ in xy], pa.int64())], ["key", "row", "col"])

    lost = own.join(stats, "bsm", "left_anti").select("bsm", "geometry").mapInArrow(points, f"key {kind}, row long, col long")
    back = nearest_pixel(lost, pixels.where("z IS NOT NULL"), radius).select(F.col("key").alias("bsm"), F.col("z").alias("fallback"))
    out = own.select("bsm").join(stats, "bsm", "left").join(back, "bsm", "left")
    how = F.when(F.col("slope_pixel_count").isNotNull(), "pixel").when(F.col("fallback").isNotNull(), "representative")
    return out.select("bsm", F.coalesce("slope_mean", "fallback").alias("slope_mean"), F.coalesce("slope_max", "fallback").alias("slope_max"), F.coalesce("slope_pixel_count", F.lit(0)).alias("slope_pixel_count"), how.alias("slope_assignment"))
