"""Contiguity, measures and joins of polygons.

Parcels and zones have a key and a `geometry` (WKB in a metric CRS). Pairs are found on
shared vertices or in the grid cells that both meet, where only that cell's part of an
outline is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.functions import codes
from parcelspark.functions import geometry as G
from parcelspark.functions import noding as N
from parcelspark.operators import cellindex, metrics
from parcelspark.scratch import ship, stash

#: Decimal places at which vertices are the same (metres: a tenth of a millimetre).
DIGITS = 4
#: Shapes that are made valid in common arrays.
TOGETHER = 2048


def _per_shape(df: DataFrame, key: str, schema: str, rows: Callable[[object, G.Polygons], list[tuple]]) -> DataFrame:
    """key and the columns of schema: the rows that each polygon gives; rows without a polygon give none."""
    ship(df.sparkSession)
    names = [key, *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                g = G.repair(G.from_wkb(raw)) if raw else []
                if g:
                    out += [(k, *r) for r in rows(k, g)]
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), *(pa.array(c, pa.float64()) for c in cols[1:])], names)

    return df.select(key, "geometry").mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, {schema}")


def measures(parcels: DataFrame, key: str = "bsm") -> DataFrame:
    """key, area_m2, perimeter, centre (x, y), box (x0, y0, x1, y1) and an inside point (px, py)."""
    one = lambda _, g: [(G.area(g), G.length(g), *G.centroid(g), *G.bounds(g), *G.interior_point(g))]
    return _per_shape(parcels, key, ", ".join(f"{c} double" for c in "area_m2 perimeter x y x0 y0 x1 y1 px py".split()), one)


def _vertices(parcels: DataFrame) -> DataFrame:
    def corners(_: object, g: G.Polygons) -> list[tuple]:
        xy = np.unique(np.round(np.concatenate([r[:-1] for p in g for r in p]), DIGITS) + 0.0, axis=0)
        return list(map(tuple, xy.tolist()))

    return _per_shape(parcels, "bsm", "vx double, vy double", corners)


def contiguity(parcels: DataFrame) -> DataFrame:
    """src, dst in both directions for parcels that share a vertex.

    A self-join on the vertex: adaptive execution splits one that very many parcels have.
    """
    a = _vertices(parcels)
    b = a.select(F.col("bsm").alias("dst"), "vx", "vy")
    return a.withColumnRenamed("bsm", "src").join(b, ["vx", "vy"]).where("src <> dst").select("src", "dst").distinct()


def block_compactness(parcels: DataFrame) -> DataFrame:
    """block, compactness: 4 pi area / perimeter squared of each block's union, whose outline are the sides that it has once.

    parcels: bsm, block, geometry; neighbours must share the vertices of their common boundary.
    """

    def sides(_: object, g: G.Polygons) -> list[tuple]:
        out = []
        for p in g:
            for r in p:
                r = np.round(r, DIGITS) + 0.0
                out += [(*min(a, b), *max(a, b)) for a, b in zip(map(tuple, r[:-1].tolist()), map(tuple, r[1:].tolist()), strict=True)]
        return out

    side = _per_shape(parcels, "bsm", "ax double, ay double, bx double, by double", sides).join(parcels.select("bsm", "block"), "bsm")
    once = side.groupBy("block", "ax", "ay", "bx", "by").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    outline = once.groupBy("block").agg(F.sum(F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))).alias("p"))
    area = measures(parcels).select("bsm", "area_m2").join(parcels.select("bsm", "block"), "bsm").groupBy("block").agg(F.sum("area_m2").alias("a"))
    return area.join(outline, "block").select("block", (4 * F.pi() * F.col("a") / (F.col("p") * F.col("p"))).alias("compactness"))


def points_in_polygons(points: DataFrame, zones: DataFrame, cell: float = 512.0, rule: str = "within") -> DataFrame:
    """key, zone_id of each point (key, px, py) and each zone (zone_id, geometry) that holds it.

    within leaves the boundary out, intersects has it, pixel gives a point on a common side to one zone.
    """
    on = {"within": "inside AND NOT edge", "intersects": "inside OR edge", "pixel": "inside"}[rule]
    found = cellindex.located(points.select("key", "px", "py"), cellindex.side_index(zones, "zone_id", cell), "zone_id", cell)
    return found.where(on).select("key", "zone_id")


def made_valid(shapes: DataFrame, key: str, digits: int | None = None) -> DataFrame:
    """key, geometry, area, length, n_polygons, n_rings, changed of each row with land: valid polygons of the same land by the even-odd rule.

    digits: coordinates on a grid of so many decimal places, where narrower parts are gone.
    """
    ship(shapes.sparkSession)
    names = [key, "geometry", "area", "length", "n_polygons", "n_rings", "changed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            keys, shapes = b.column(0).to_pylist(), [G.from_wkb(raw) if raw else [] for raw in b.column(1).to_pylist()]
            for at in range(0, len(keys), TOGETHER):
                made = N.make_all_valid(shapes[at : at + TOGETHER])
                if digits is not None:
                    made = [(g, True) for g in N.set_all_precisions([g for g, _ in made], digits)]
                rows += [(k, G.to_wkb(g), G.area(g), G.length(g), len(g), sum(map(len, g)), changed) for k, (g, changed) in zip(keys[at : at + TOGETHER], made, strict=True) if g]
            if rows:
                kinds = [b.schema.field(0).type, pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return shapes.select(key, "geometry").mapInArrow(run, f"{key} {dict(shapes.dtypes)[key]}, geometry binary, area double, length double, n_polygons long, n_rings long, changed boolean")


def dissolve(parcels: DataFrame, by: list[str], digits: int = DIGITS) -> DataFrame:
    """by, geometry, area, length, n_polygons, n_rings, n_parcels: the union of each group's polygons.

    A side that two parcels have cancels before anything of a group comes together, in
    sums that are made before the exchange; what is left is the outline, which becomes one
    value of the result. There sides are split where neighbours meet without common
    vertices, and overlaps are counted once.
    """
    own = parcels.select(F.monotonically_increasing_id().alias("__row"), *by, "geometry")

    def directed(_: object, g: G.Polygons) -> list[tuple]:
        out = []
        for p in g:
            for r in p:
                r = np.round(r, digits) + 0.0
                for a, b in zip(map(tuple, r[:-1].tolist()), map(tuple, r[1:].tolist()), strict=True):
                    if a != b:
                        out.append((*a, *b, 1.0) if a < b else (*b, *a, -1.0))
        return out

    # by is carried inside the key, so that sides need no join back to their parcel
    keyed = own.select(F.struct(*by).alias("__by"), "geometry")
    side = _per_shape(keyed.withColumn("__by", F.to_json("__by", {"ignoreNullFields": "false"})), "__by", "ax double, ay double, bx double, by double, way double", directed)
    left = side.groupBy("__by", "ax", "ay", "bx", "by").agg(F.sum("way").cast("long").alias("way")).where("way <> 0")

    def assemble(sides: pa.Table) -> pa.Table:
        s = np.stack([np.asarray(sides[c]) for c in ("ax", "ay", "bx", "by")], 1)
        g = N.rebuilt(s, np.asarray(sides["way"]), digits)
        cols = [sides["__by"][:1].combine_chunks(), pa.array([G.to_wkb(g)], pa.binary()), *(pa.array([float(f(g))]) for f in (G.area, G.length)), pa.array([len(g)]), pa.array([sum(map(len, g))])]
        return pa.table(cols, names=["__by", "geometry", "area", "length", "n_polygons", "n_rings"])

    shapes = left.groupBy("__by").applyInArrow(assemble, "__by string, geometry binary, area double, length double, n_polygons long, n_rings long")
    counts = own.groupBy(*by).agg(F.count(F.lit(1)).alias("n_parcels")).withColumn("__by", F.to_json(F.struct(*by), {"ignoreNullFields": "false"}))
    return counts.join(shapes, "__by").select(*by, "geometry", "area", "length", "n_polygons", "n_rings", "n_parcels")


def admin_proxy(parcels: DataFrame) -> DataFrame:
    """Administrative units made of the parcels themselves (qsdwdm, qsdwmc, geometry), where no reference layer is given."""
    units = dissolve(parcels, ["qsdwdm", "qsdwmc"]).withColumnsRenamed({"qsdwdm": "XZQDM", "qsdwmc": "XZQMC"})
    level = {"admin_level": codes.admin_level(F.col("XZQDM")), "admin_parent_code": F.substring("XZQDM", 1, 9), "source_level": F.lit("DLTB_QSDWDM_DISSOLVE"), "source_dataset": F.lit("authoritative_dltb"), "not_for_production": F.lit(True)}
    return units.withColumns(level)


def zonal(cells: DataFrame, zones: DataFrame, key: str, cell: float = 512.0) -> DataFrame:
    """key, mean, max, n of the raster cells (row, col, z, centre px, py) whose centre a polygon holds; the largest key takes a cell."""
    hits = cellindex.located(cells, cellindex.side_index(zones, key, cell), key, cell).where("inside")
    burnt = hits.groupBy("row", "col").agg(F.max(key).alias(key), F.first("z").alias("z"))
    return burnt.groupBy(key).agg(F.avg("z").alias("mean"), F.max("z").alias("max"), F.count(F.lit(1)).alias("n"))


def labels(parcels: DataFrame, zones: DataFrame, name: str, cell: float = 512.0, spot: tuple[str, str] = ("x", "y")) -> DataFrame:
    """bsm and the name of the zone within which the parcel's centroid lies (spot: another pair of its measures).

    Of several zones that with the smallest zone_id; null outside all.
    """
    spots = measures(parcels).select(F.col("bsm").alias("key"), F.col(spot[0]).alias("px"), F.col(spot[1]).alias("py"))
    first = points_in_polygons(spots, zones, cell).groupBy("key").agg(F.min("zone_id").alias("zone_id")).join(zones.select("zone_id", name), "zone_id")
    return spots.select("key").join(first, "key", "left").select(F.col("key").alias("bsm"), name)


def township_labels(named: DataFrame) -> DataFrame:
    """township, label: the most frequent label of a township's parcels, of equals the first; rows: township, label (null: none)."""
    counts = named.where("label IS NOT NULL").groupBy("township", "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("township").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b")).select("township", F.col("b.label").alias("label"))


def admin_units(parcels: DataFrame, units: DataFrame, attrs: list[str], cell: float = 512.0) -> DataFrame:
    """One row per unit (unit_id, attrs): parcels that mostly lie in it, their area and share of all.

    A parcel belongs to the unit with which it shares most land, of equals to the smaller unit_id.
    """
    from parcelspark.operators.fusion import dominant

    zones = units.withColumnRenamed("unit_id", "zone_id")
    best = stash(dominant(parcels, zones.withColumn("unit_id", F.col("zone_id")), ["unit_id", *attrs], cell), "dominant")
    # only parcels of a unit are measured
    box = measures(parcels.join(best.select("bsm"), "bsm", "left_semi")).select("bsm", F.col("area_m2").alias("area"))
    per = best.join(box, "bsm").groupBy("unit_id", *attrs).agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area_m2"))
    every = per.agg(F.sum("area_m2").alias("all_m2"))
    return per.crossJoin(F.broadcast(every)).withColumn("share", F.col("area_m2") / F.col("all_m2")).drop("all_m2")  # one row


def reference_units(parcels: DataFrame, reference: DataFrame, county: str | None = None, cell: float = 512.0) -> DataFrame:
    """Units of one county from a reference layer, with the code of the parcels that mostly lie in each.

    reference: unit_id, county_code, XZQMC, geometry; parcels: bsm, qsdwdm, geometry. county:
    by default the most frequent county code of the parcels. A unit's code is the leading
    part of the location code that covers most of it, of equals the smallest; empty without
    parcels. A county without units, or units without a name, are errors.
    """
    if county is None:
        county = metrics.most_frequent(parcels.select(codes.county_code(F.col("qsdwdm")).alias("code")), "code").first()["code"]
    named = reference.withColumns({"county_code": codes.normalise_code(F.col("county_code")), "XZQMC": F.trim(F.coalesce("XZQMC", F.lit("")))})
    own = named.where(F.col("county_code") == county)
    seen = own.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("XZQMC") == "").alias("blank")).first()
    if not seen["n"]:
        known = [r[0] for r in named.select("county_code").distinct().orderBy("county_code").limit(20).collect()]
        raise ValueError(f"no units of county {county!r}; there are {known}")
    if seen["blank"]:
        raise ValueError(f"{seen['blank']} units without a name")
    code = F.substring("qsdwdm", 1, 9)
    area = cellindex.overlaps(cellindex.piece_index(parcels, "bsm", cell), cellindex.piece_index(own, "unit_id", cell), "bsm", "unit_id")
    per = area.join(parcels.select("bsm", code.alias("code")), "bsm")
    # overlaps are counted by parcel, as the reference layer's units meet parcels and not their union
    best = per.groupBy("unit_id").agg(F.min(F.struct((-F.round("area", 6)).alias("a"), "code")).alias("b")).select("unit_id", F.col("b.code").alias("code"))
    out = own.join(best, "unit_id", "left")
    level = {"XZQDM": F.coalesce("code", F.lit("")), "admin_level": F.lit("township"), "admin_parent_code": F.lit(county)}
    source = {"code_source": F.when(F.col("code").isNull(), "UNAVAILABLE").otherwise("DLTB_DOMINANT_OVERLAP"), "source_level": F.lit("BUNDLED_TOWNSHIP_SPATIAL_REFERENCE"), "not_for_exchange_constraints": F.lit(True)}
    return out.withColumns(level | source).drop("code")


def build_admin_units(parcels: DataFrame, reference: DataFrame | None = None, county: str | None = None) -> DataFrame:
    """Units of the reference layer, or without one those dissolved from the parcels (bsm, qsdwdm, qsdwmc, geometry)."""
    return admin_proxy(parcels) if reference is None else reference_units(parcels, reference, county)


def numbered(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """df with a dense number of its distinct key values, which are few (a county's blocks)."""
    known = df.select(*keys).distinct()
    return df.join(known.withColumn(name, F.row_number().over(Window.orderBy(*keys)) - 1), list(keys))
