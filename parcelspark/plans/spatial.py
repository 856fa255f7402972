"""Queries of overlay joins, rasters and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.domain import parcel, pixel, swap, unit, zone
from parcelspark.operators import graph, overlay
from parcelspark.plans.registry import query

_OV = "greatest(0, least(p.x1, z.x1) - greatest(p.x0, z.x0)) * greatest(0, least(p.y1, z.y1) - greatest(p.y0, z.y0))"
_MEETS = "p.x0 < z.x1 AND z.x0 < p.x1 AND p.y0 < z.y1 AND z.y0 < p.y1"


@query(f"SELECT bsm, zone_id, pdjb, area FROM (SELECT p.bsm, z.zone_id, z.pdjb, {_OV} AS area, row_number() OVER (PARTITION BY p.bsm ORDER BY {_OV} DESC, z.zone_id) AS k FROM parcel p JOIN zone z ON {_MEETS}) WHERE k = 1", "parcel", "zone")
def dominant_overlap(spark: SparkSession, d: str) -> DataFrame:
    return overlay.dominant_overlap(parcel(spark, d), zone(spark, d))


@query(f""", xs AS (SELECT bsm, x FROM parcel, LATERAL (SELECT unnest([x0, x1]) AS x) UNION SELECT p.bsm, unnest([greatest(z.x0, p.x0), least(z.x1, p.x1)]) FROM parcel p JOIN zone z ON {_MEETS}),
ys AS (SELECT bsm, y FROM parcel, LATERAL (SELECT unnest([y0, y1]) AS y) UNION SELECT p.bsm, unnest([greatest(z.y0, p.y0), least(z.y1, p.y1)]) FROM parcel p JOIN zone z ON {_MEETS}),
xi AS (SELECT bsm, x AS a, lead(x) OVER (PARTITION BY bsm ORDER BY x) AS b FROM xs), yi AS (SELECT bsm, y AS a, lead(y) OVER (PARTITION BY bsm ORDER BY y) AS b FROM ys),
cells AS (SELECT xi.bsm, xi.a AS xa, xi.b AS xb, yi.a AS ya, yi.b AS yb FROM xi JOIN yi USING (bsm) WHERE xi.b IS NOT NULL AND yi.b IS NOT NULL)
SELECT c.bsm, sum((xb - xa) * (yb - ya))::DOUBLE AS area FROM cells c WHERE EXISTS (SELECT 1 FROM zone z WHERE z.x0 <= xa AND z.x1 >= xb AND z.y0 <= ya AND z.y1 >= yb) GROUP BY c.bsm""", "parcel", "zone")
def constraint_overlap(spark: SparkSession, d: str) -> DataFrame:
    return overlay.dissolved_overlap(parcel(spark, d), zone(spark, d))


@query("SELECT p.bsm, min(z.zone_id) AS zone_id FROM parcel p LEFT JOIN zone z ON (p.x0 + p.x1) / 2 > z.x0 AND (p.x0 + p.x1) / 2 < z.x1 AND (p.y0 + p.y1) / 2 > z.y0 AND (p.y0 + p.y1) / 2 < z.y1 GROUP BY p.bsm HAVING zone_id IS NOT NULL", "parcel", "zone")
def label_within(spark: SparkSession, d: str) -> DataFrame:
    p = parcel(spark, d).select("bsm", ((F.col("x0") + F.col("x1")) / 2).alias("px"), ((F.col("y0") + F.col("y1")) / 2).alias("py"))
    return overlay.points_in_boxes(p, zone(spark, d), within=True).groupBy("p.bsm").agg(F.min("b.zone_id").alias("zone_id"))


_BURNT = ", burnt AS (SELECT p.row, p.col, max(z.zone_id) AS zone_id, any_value(p.z) AS z FROM pixel p JOIN zone z ON (p.col + 0.5) * 100 >= z.x0 AND (p.col + 0.5) * 100 < z.x1 AND (p.row + 0.5) * 100 >= z.y0 AND (p.row + 0.5) * 100 < z.y1 WHERE p.z > 0 GROUP BY p.row, p.col)"


@query(_BURNT + " SELECT zone_id, count(*) AS n, min(row) AS first_row, max(row) AS last_row FROM burnt GROUP BY zone_id", "pixel", "zone")
def zonal_join(spark: SparkSession, d: str) -> DataFrame:
    p = pixel(spark, d).where("z > 0").select("row", "col", ((F.col("col") + 0.5) * 100).alias("px"), ((F.col("row") + 0.5) * 100).alias("py"))
    burnt = overlay.points_in_boxes(p, zone(spark, d)).groupBy("p.row", "p.col").agg(F.max("b.zone_id").alias("zone_id"))
    return burnt.groupBy("zone_id").agg(F.count("*").alias("n"), F.min("row").alias("first_row"), F.max("row").alias("last_row"))


@query(_BURNT + " SELECT zone_id, round(avg(z), 4) AS mean, max(z) AS max, count(*) AS n FROM burnt GROUP BY zone_id", "pixel", "zone")
def zonal_stats(spark: SparkSession, d: str) -> DataFrame:
    return overlay.zonal_stats(pixel(spark, d), zone(spark, d), 100).withColumn("mean", F.round("mean", 4))


@query(_BURNT + " SELECT CASE WHEN n IS NULL THEN 'none' WHEN n < 5 THEN 'few' ELSE 'pixel' END AS assignment, count(*) AS zones, round(min(mean), 4) AS lowest, round(max(mean), 4) AS highest FROM zone LEFT JOIN (SELECT zone_id, count(*) AS n, avg(z) AS mean FROM burnt GROUP BY zone_id) USING (zone_id) GROUP BY assignment", "pixel", "zone")
def slope_report(spark: SparkSession, d: str) -> DataFrame:
    s = overlay.zonal_stats(pixel(spark, d), zone(spark, d), 100)
    kind = F.when(F.col("n").isNull(), "none").when(F.col("n") < 5, "few").otherwise("pixel")
    return zone(spark, d).join(s, "zone_id", "left").groupBy(kind.alias("assignment")).agg(F.count("*").alias("zones"), F.round(F.min("mean"), 4).alias("lowest"), F.round(F.max("mean"), 4).alias("highest"))


@query("SELECT key, z, d2 FROM (SELECT a.row * 100 + a.col AS key, b.z, (b.row - a.row) * (b.row - a.row) + (b.col - a.col) * (b.col - a.col) AS d2, row_number() OVER (PARTITION BY a.row, a.col ORDER BY (b.row - a.row) * (b.row - a.row) + (b.col - a.col) * (b.col - a.col), b.row, b.col) AS k FROM pixel a JOIN pixel b ON b.row BETWEEN a.row - 2 AND a.row + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 AND b.z > 0 WHERE a.z <= 0) WHERE k = 1", "pixel")
def nearest_pixel_fallback(spark: SparkSession, d: str) -> DataFrame:
    p = pixel(spark, d)
    missing = p.where("z <= 0").select((F.col("row") * 100 + F.col("col")).alias("key"), "row", "col")
    return overlay.nearest_pixel(missing, p, valid="z > 0")


def _horn(strict: bool) -> str:
    """Nine reads of each cell, positions clamped to the grid."""
    reads = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]
    joins = " ".join(f"LEFT JOIN pixel n{i} ON n{i}.row = least(greatest(a.row + {dr}, r0), r1) AND n{i}.col = least(greatest(a.col + {dc}, c0), c1)" for i, (dr, dc) in enumerate(reads))
    v = [f"CASE WHEN n{i}.z > 0 THEN n{i}.z END" for i in range(9)]
    need = " AND ".join(f"n{i}.z > 0" for i, x in enumerate(reads) if strict or x != (0, 0))
    gx = f"(({v[2]}) + 2 * ({v[5]}) + ({v[8]}) - ({v[0]}) - 2 * ({v[3]}) - ({v[6]})) / 240.0"
    gy = f"(({v[6]}) + 2 * ({v[7]}) + ({v[8]}) - ({v[0]}) - 2 * ({v[1]}) - ({v[2]})) / 240.0"
    return f"SELECT a.row, a.col, round(degrees(atan(sqrt(pow({gx}, 2) + pow({gy}, 2)))), 5) AS slope FROM pixel a CROSS JOIN (SELECT min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM pixel) {joins} WHERE {need}"


@query(_horn(False), "pixel")
def horn_slope(spark: SparkSession, d: str) -> DataFrame:
    """Cells whose eight neighbours have data."""
    return overlay.horn_slope(pixel(spark, d), 30.0, False).where("slope IS NOT NULL").withColumn("slope", F.round("slope", 5))


@query(_horn(True), "pixel")
def horn_slope_strict(spark: SparkSession, d: str) -> DataFrame:
    """Cells that have data and whose eight neighbours have data."""
    return overlay.horn_slope(pixel(spark, d), 30.0, True).where("slope IS NOT NULL").withColumn("slope", F.round("slope", 5))


_G = "CASE WHEN row_number() OVER {w} = 1 THEN (lead(z) OVER {w} - z) / {s} WHEN lead({k}) OVER {w} IS NULL THEN (z - lag(z) OVER {w}) / {s} ELSE (lead(z) OVER {w} - lag(z) OVER {w}) / {s2} END"


@query(", p AS (SELECT row, col, CASE WHEN z > 0 THEN z END AS z FROM pixel) SELECT row, col, round(degrees(atan(sqrt(gx * gx + gy * gy))), 5) AS slope FROM (SELECT row, col, z, " + _G.format(w="r", k="col", s="28.0", s2="56.0") + " AS gx, " + _G.format(w="c", k="row", s="30.0", s2="60.0") + " AS gy FROM p WINDOW r AS (PARTITION BY row ORDER BY col), c AS (PARTITION BY col ORDER BY row)) WHERE gx IS NOT NULL AND gy IS NOT NULL", "pixel")
def gradient_slope(spark: SparkSession, d: str) -> DataFrame:
    return overlay.gradient_slope(pixel(spark, d), 28.0, 30.0).where("slope IS NOT NULL").withColumn("slope", F.round("slope", 5))


@query("SELECT row, col, min_by(z, tile) AS z, count(*) AS tiles FROM (SELECT row, col, z, 0 AS tile FROM pixel WHERE row <= 20 UNION ALL SELECT row, col, z + 1, 1 FROM pixel WHERE row >= 15) GROUP BY row, col", "pixel")
def mosaic_union(spark: SparkSession, d: str) -> DataFrame:
    """Two overlapping tiles; the first wins."""
    p = pixel(spark, d)
    tiles = p.where("row <= 20").withColumn("tile", F.lit(0)).unionByName(p.where("row >= 15").withColumn("z", F.col("z") + 1).withColumn("tile", F.lit(1)))
    return tiles.groupBy("row", "col").agg(F.min_by("z", "tile").alias("z"), F.count("*").alias("tiles"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.queen_edges(swap(spark, d).where("type_code > 0"))


@query("SELECT * FROM edge", "edge")
def queen_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


@query("SELECT src, count(*) AS degree FROM edge GROUP BY src", "edge")
def degree(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).groupBy("src").agg(F.count("*").alias("degree"))


@query("SELECT src AS bsm, count(*) FILTER (td = 1) AS farm_nbrs FROM edge GROUP BY src", "edge")
def farm_nbr_count(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).groupBy(F.col("src").alias("bsm")).agg(F.count_if(F.col("td") == 1).alias("farm_nbrs"))


@query("SELECT DISTINCT a.block AS bs, b.block AS bd FROM edge JOIN swap a ON a.bsm = src JOIN swap b ON b.bsm = dst WHERE a.block <> b.block", "edge")
def block_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return graph.block_adjacency(_edges(spark, d), swap(spark, d).select("bsm", "block"))


@query("SELECT count(*) FILTER (a.township <> b.township) // 2 AS parcels, count(DISTINCT CASE WHEN a.township <> b.township AND a.block <> b.block THEN least(a.block, b.block) * 1000000 + greatest(a.block, b.block) END) AS blocks FROM edge JOIN swap a ON a.bsm = src JOIN swap b ON b.bsm = dst", "edge")
def cross_township_edges(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of parcels and pairs of blocks on two sides of a township boundary."""
    s = swap(spark, d).select("bsm", "township", "block")
    side = lambda k, t, b: s.select(F.col("bsm").alias(k), F.col("township").alias(t), F.col("block").alias(b))
    e = _edges(spark, d).join(side("src", "ta", "ba"), "src").join(side("dst", "tb", "bb"), "dst").where("ta <> tb")
    return e.agg((F.count("*") / 2).cast("long").alias("parcels"), F.countDistinct(F.when(F.col("ba") != F.col("bb"), F.least("ba", "bb") * 1000000 + F.greatest("ba", "bb"))).alias("blocks"))


@query("SELECT src, dst FROM edge UNION SELECT a.src, b.dst FROM edge a JOIN edge b ON a.dst = b.src WHERE a.src <> b.dst", "edge")
def two_hop(spark: SparkSession, d: str) -> DataFrame:
    """Neighbourhoods of all parcels."""
    return graph.two_hop(_edges(spark, d))


@query(", m AS (SELECT count(*) AS n, sum(area_m2) AS area, sum(slope_mean * area_m2) AS sa FROM swap WHERE type_code = 1) SELECT n, area, round(sa / greatest(area, 1e-8), 6) AS slope, round((SELECT count(*) FROM edge WHERE ts = 1 AND td = 1) / greatest(n, 1), 6) AS contiguity FROM m", "edge")
def county_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Farmland parcels, area, area-weighted slope, and farmland neighbours per parcel."""
    farm = swap(spark, d).where("type_code = 1")
    m = farm.agg(F.count("*").alias("n"), F.sum("area_m2").alias("area"), F.sum(F.col("slope_mean") * F.col("area_m2")).alias("sa"))
    e = graph.queen_edges(farm).agg(F.count("*").alias("e"))
    return m.crossJoin(e).select("n", "area", F.round(F.col("sa") / F.greatest("area", F.lit(1e-8)), 6).alias("slope"), F.round(F.col("e") / F.greatest("n", F.lit(1)), 6).alias("contiguity"))


@query(", cc(id, l) USING KEY (id) AS (SELECT bsm, bsm FROM swap WHERE type_code = 1 UNION SELECT e.dst, min(c.l) FROM cc c JOIN edge e ON e.src = c.id JOIN recurring.cc o ON o.id = e.dst WHERE e.ts = 1 AND e.td = 1 AND c.l < o.l GROUP BY e.dst), p AS (SELECT l, sum(area_m2) AS area FROM cc JOIN swap ON bsm = id GROUP BY l) SELECT count(*) FILTER (area >= 66700) AS patches, coalesce(sum(area) FILTER (area >= 66700), 0) AS area, count(*) AS components FROM p", "edge")
def baimu_fang(spark: SparkSession, d: str) -> DataFrame:
    """Contiguous farmland of at least 66 700 square metres."""
    s = swap(spark, d)
    big = F.col("area") >= 66700
    return graph.patches(s).agg(F.count_if(big).alias("patches"), F.coalesce(F.sum(F.when(big, F.col("area"))), F.lit(0.0)).alias("area"), F.count("*").alias("components"))


@query("SELECT u.unit_id, v.unit_id AS downstream FROM unit u JOIN unit v ON (v.row = u.row + 1 AND v.col = u.col) OR (v.row = u.row AND v.col = u.col + 1)", "unit")
def downstream_rowcol(spark: SparkSession, d: str) -> DataFrame:
    """Southern and eastern neighbours on the unit grid: an equi-join on the shifted cell."""
    u = unit(spark, d).select("unit_id", "row", "col")
    shift = F.explode(F.array(F.struct((F.col("row") + 1).alias("r"), F.col("col").alias("c")), F.struct(F.col("row").alias("r"), (F.col("col") + 1).alias("c"))))
    v = u.select(F.col("unit_id").alias("downstream"), F.col("row").alias("r"), F.col("col").alias("c"))
    return u.select("unit_id", shift.alias("s")).join(v, (F.col("s.r") == F.col("r")) & (F.col("s.c") == F.col("c"))).select("unit_id", "downstream")
