"""Fusion of four sources from files: parcels, slope classes, protection zones and elevation into one layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.functions import codes
from parcelspark.functions import crs as C
from parcelspark.operators import fusion, resample
from parcelspark.operators.overlay import horn_slope
from parcelspark.scratch import stash
from parcelspark.sources import files, geopackage, layers, raster, writers

#: Sources besides the parcels and the elevation; all of them or none.
ZONES = ["pdt", "eco", "pbf"]


def slope_of(spark: SparkSession, parcels: DataFrame, dem: str | list[str], system: C.Crs | None = None) -> DataFrame:
    """bsm and slope statistics of each parcel from elevation files, which must lie over the parcels.

    The slope is that of the raster's own grid, its cells measured in metres, and parcels
    meet it in its coordinate system. system: the parcels'; without it both are taken to be
    in one system of metres.
    """
    box = fusion.boxed(parcels, "bsm").agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).first()
    if box[0] is None:
        raise ValueError("the parcels have no land")
    model = raster.read_elevation(spark, dem, tuple(box), system)
    if system is not None and model.crs is None:
        raise raster.RasterError("the elevation has no coordinate system")
    own = system or C.opaque(0)
    grid = model.grid
    dx, dy, _ = C.cell_metres((grid.dx, 0.0, grid.x0, 0.0, grid.dy, grid.y0), model.crs if system and model.crs else own, grid.rows)
    slope = horn_slope(model.cells, (dx, dy), False).withColumnRenamed("slope", "z")
    there = resample.moved(parcels, "bsm", own, model.crs) if system else parcels.select("bsm", "geometry")
    return fusion.polygon_slope(there, slope, (grid.dx, -grid.dy), (grid.x0, grid.y0))


def resolved(sources: dict[str, str]) -> dict[str, str]:
    """The source of each role: its own, else the common one (`source`) that holds several; zones only where any is given."""
    common = sources.get("source")
    wanted = ["parcels", *(ZONES if common or any(z in sources for z in ZONES) else [])]
    out = {role: sources.get(role) or common for role in wanted}
    if missing := [role for role, path in out.items() if not path]:
        raise ValueError(f"zones need all of {ZONES}; no source for {missing}")
    return out | ({"dem": sources["dem"]} if "dem" in sources else {})


def fuse_files(spark: SparkSession, sources: dict[str, str], chosen: dict[str, str] | None = None, threshold: float = 1.0, metric: str | None = None, counts: dict | None = None) -> DataFrame:
    """The fused layer. sources: parcels, dem and the zones (all or none), or one `source` for all roles; GeoPackages (dem: GeoTIFF); chosen: layer names by role.

    Without zones the constraints are neutral and marked as not evaluated. Areas are
    measured in a metric system: the given one, else the parcels' own, else their UTM zone.
    The result is in that system. counts gets what was read, repaired and dropped by role.
    """
    chosen = chosen or {}
    sources = resolved(sources)
    given = [z for z in ZONES if z in sources]
    if "dem" not in sources:
        raise ValueError("an elevation file is needed")

    def system(role: str) -> C.Crs:
        """Of the layer that is read for the role."""
        known = [(r["layer"], r["geometry_type"], r["fields"]) for r in files.list_layers(spark, sources[role]).collect()]
        return geopackage.layer_crs(sources[role], layers.select_layer(known, role, chosen.get(role)))

    def read(role: str, key: str) -> DataFrame:
        out = layers.read_role(spark, sources[role], role, chosen.get(role), counts=counts).withColumnRenamed("fid", key)
        own = system(role)
        # a layer is read and checked once; every later step reads the written table
        out = stash(out, f"layer-{role}")
        return out if own.same(target) else out.drop("geometry").join(resample.moved(out, key, own, target), key)

    first = system("parcels")
    box = (0.0,) * 4
    if first.geographic and not metric:
        raw = fusion.boxed(layers.read_role(spark, sources["parcels"], "parcels", chosen.get("parcels")), "fid")
        box = tuple(raw.agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).first())
    target = C.choose_metric(metric, first, box)
    parcels = read("parcels", "fid")
    parcels = parcels.select(F.col("fid").alias("bsm"), F.col("bsm").alias("BSM_TEXT"), codes.normalise_land_use_code(F.col("dlbm")).alias("dlbm"), "dlmc", codes.normalise_code(F.col("qsdwdm")).alias("qsdwdm"), "qsdwmc", "geometry")
    slope = slope_of(spark, parcels, sources["dem"], target)
    if not given:
        return fusion.fuse_without_zones(parcels, slope)
    zone = lambda role: read(role, "zone_id")
    return fusion.fuse(parcels, slope, zone("pdt"), zone("eco").select("zone_id", "geometry"), zone("pbf").select("zone_id", "geometry"), threshold)


def write_fused(fused: DataFrame, path: str, epsg: int, name: str = "dltb") -> None:
    """The fused layer as a GeoPackage under the published field names."""
    out = fused.drop("bsm").withColumnsRenamed({"BSM_TEXT": "BSM", "dlbm": "DLBM", "dlmc": "DLMC", "qsdwdm": "QSDWDM", "qsdwmc": "QSDWMC"})
    writers.write_gpkg({name: out}, path, epsg)


def write_placeholder(parcels: DataFrame, path: str, epsg: int) -> None:
    """The placeholder raster over the extent of the parcels, beside a fused layer that has its slopes already."""
    box = fusion.boxed(parcels, "bsm").agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).first()
    raw = raster.placeholder(tuple(v or 0.0 for v in box), epsg)
    with open(path, "wb") as f:
        f.write(raw)
