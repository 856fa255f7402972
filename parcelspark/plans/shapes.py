"""Queries over real polygons: parcels are the lower left halves of their boxes, zones are boxes.

The SQL has closed forms for these shapes: the height of a triangle falls with x, so
its overlap with a box is a difference of two quadratics in that height.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.domain import box_polygons, parcel, pixel, rings, swap, triangle_polygons, zone
from parcelspark.operators import cellindex, fusion, polygons
from parcelspark.plans.registry import query

#: Area below height h of the strip from lo to hi, as the height falls to lo.
_BELOW = "CASE WHEN {h} <= lo THEN 0 WHEN {h} <= hi THEN ({h} - lo) * ({h} - lo) / 2 ELSE (hi - lo) * (hi - lo) / 2 + ({h} - hi) * (hi - lo) END"
_HEIGHTS = "SELECT p.bsm, z.zone_id, z.pdjb, greatest(p.y0, z.y0) AS lo, greatest(greatest(p.y0, z.y0), least(p.y1, z.y1)) AS hi, p.y0 + p.x1 - greatest(p.x0, z.x0) AS ha, p.y0 + p.x1 - greatest(greatest(p.x0, z.x0), least(p.x1, z.x1)) AS hb FROM parcel p JOIN zone z ON p.x0 < z.x1 AND z.x0 < p.x1 AND p.y0 < z.y1 AND z.y0 < p.y1"
_TRIANGLE = f", h AS ({_HEIGHTS}), ov AS (SELECT bsm, zone_id, pdjb, ({_BELOW.format(h='ha')}) - ({_BELOW.format(h='hb')}) AS area FROM h)"


@query("SELECT bsm, (x1 - x0) * (y1 - y0) / 2 AS area_m2, round((x1 - x0) + (y1 - y0) + sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)), 6) AS perimeter, round(x0 + (x1 - x0) / 3, 6) AS x, round(y0 + (y1 - y0) / 3, 6) AS y FROM parcel", "parcel")
def polygon_measures(spark: SparkSession, d: str) -> DataFrame:
    m = polygons.measures(triangle_polygons(parcel(spark, d), "bsm"))
    return m.select("bsm", "area_m2", *(F.round(c, 6).alias(c) for c in ("perimeter", "x", "y")))


@query(_TRIANGLE + " SELECT bsm, zone_id, pdjb, round(area, 5) AS area FROM (SELECT *, row_number() OVER (PARTITION BY bsm ORDER BY area DESC, zone_id) AS k FROM ov WHERE area > 0) WHERE k = 1", "parcel", "zone")
def polygon_dominant_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The zone that covers most of each triangle, by exact areas of polygons."""
    own = triangle_polygons(parcel(spark, d), "bsm")
    zones = box_polygons(zone(spark, d), "zone_id").join(zone(spark, d).select("zone_id", "pdjb"), "zone_id")
    best = fusion.dominant(own, zones.withColumn("zone", F.col("zone_id")), ["zone", "pdjb"], 512.0)
    return best.select("bsm", F.col("zone").alias("zone_id"), "pdjb", F.round("ov", 5).alias("area"))


@query(", c AS (SELECT bsm, block, x0 AS vx, y0 AS vy FROM swap WHERE type_code > 0 UNION ALL SELECT bsm, block, x1, y0 FROM swap WHERE type_code > 0 UNION ALL SELECT bsm, block, x0, y1 FROM swap WHERE type_code > 0) SELECT DISTINCT a.bsm AS src, b.bsm AS dst FROM c a JOIN c b ON a.vx = b.vx AND a.vy = b.vy AND a.bsm <> b.bsm", "swap")
def polygon_contiguity(spark: SparkSession, d: str) -> DataFrame:
    """Triangles that share a vertex."""
    return polygons.contiguity(triangle_polygons(swap(spark, d).where("type_code > 0"), "bsm"))


@query(", i AS (SELECT p.bsm, z.zone_id FROM parcel p JOIN zone z ON p.x0 + (p.x1 - p.x0) / 4 > z.x0 AND p.x0 + (p.x1 - p.x0) / 4 < z.x1 AND p.y0 + (p.y1 - p.y0) / 2 > z.y0 AND p.y0 + (p.y1 - p.y0) / 2 < z.y1) SELECT p.bsm, 'Z' || min(zone_id) AS label FROM parcel p LEFT JOIN i USING (bsm) GROUP BY p.bsm", "parcel", "zone")
def polygon_labels(spark: SparkSession, d: str) -> DataFrame:
    """The first zone that holds the inside point of each triangle: the middle of its width at half its height."""
    zones = box_polygons(zone(spark, d), "zone_id").withColumn("label", F.concat(F.lit("Z"), F.col("zone_id").cast("string")))
    return polygons.labels(triangle_polygons(parcel(spark, d), "bsm"), zones, "label", spot=("px", "py"))


@query(", i AS (SELECT p.bsm, z.zone_id FROM parcel p JOIN zone z ON p.x0 + (p.x1 - p.x0) / 3 > z.x0 AND p.x0 + (p.x1 - p.x0) / 3 < z.x1 AND p.y0 + (p.y1 - p.y0) / 3 > z.y0 AND p.y0 + (p.y1 - p.y0) / 3 < z.y1) SELECT p.bsm, 'Z' || min(zone_id) AS label FROM parcel p LEFT JOIN i USING (bsm) GROUP BY p.bsm", "parcel", "zone")
def centroid_labels(spark: SparkSession, d: str) -> DataFrame:
    """The first zone within which the centroid of each triangle lies."""
    zones = box_polygons(zone(spark, d), "zone_id").withColumn("label", F.concat(F.lit("Z"), F.col("zone_id").cast("string")))
    return polygons.labels(triangle_polygons(parcel(spark, d), "bsm"), zones, "label")


@query(", v AS (SELECT bsm, x0 AS px, y0 AS py FROM parcel) SELECT v.bsm, count(*) FILTER (px > z.x0 AND px < z.x1 AND py > z.y0 AND py < z.y1) AS within, count(*) AS touched, count(*) FILTER (px >= z.x0 AND px < z.x1 AND py >= z.y0 AND py < z.y1) AS pixel FROM v JOIN zone z ON px BETWEEN z.x0 AND z.x1 AND py BETWEEN z.y0 AND z.y1 GROUP BY v.bsm", "parcel", "zone")
def corner_predicates(spark: SparkSession, d: str) -> DataFrame:
    """How many zones hold the corner of each parcel by the three rules of the boundary; many corners lie on sides."""
    points = parcel(spark, d).select("bsm", F.col("x0").cast("double").alias("px"), F.col("y0").cast("double").alias("py"))
    found = cellindex.located(points, cellindex.side_index(box_polygons(zone(spark, d), "zone_id"), "zone_id", 256.0), "zone_id", 256.0)
    return found.groupBy("bsm").agg(F.count_if(F.expr("inside AND NOT edge")).alias("within"), F.count("*").alias("touched"), F.count_if("inside").alias("pixel"))


_WHOLE = f""", xs AS (SELECT bsm, x FROM parcel, LATERAL (SELECT unnest([x0, x1]) AS x) UNION SELECT p.bsm, unnest([greatest(z.x0, p.x0), least(z.x1, p.x1)]) FROM parcel p JOIN zone z ON {{meets}} UNION SELECT p.bsm, greatest(p.x0, least(p.x1, p.x0 + p.y1 - unnest([z.y0, z.y1]))) FROM parcel p JOIN zone z ON {{meets}}),
xi AS (SELECT bsm, x AS a, lead(x) OVER (PARTITION BY bsm ORDER BY x) AS b FROM xs),
m AS (SELECT xi.bsm, xi.a, xi.b, z.zone_id, greatest(z.y0, p.y0) AS lo, least(z.y1, p.y0 + p.x1 - (xi.a + xi.b) / 2) AS hi FROM xi JOIN parcel p USING (bsm) JOIN zone z ON {{meets}} AND z.x0 <= xi.a AND z.x1 >= xi.b WHERE xi.b IS NOT NULL),
t AS (SELECT *, max(hi) OVER (PARTITION BY bsm, a ORDER BY lo, hi, zone_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM m WHERE hi > lo)
SELECT bsm, round(sum((b - a) * greatest(0, hi - greatest(lo, coalesce(top, lo)))), 4) AS area FROM t GROUP BY bsm"""


@query(_WHOLE.replace("{meets}", "p.x0 < z.x1 AND z.x0 < p.x1 AND p.y0 < z.y1 AND z.y0 < p.y1"), "parcel", "zone")
def polygon_constraint_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Land of each triangle that any zone covers, counted once: slabs between all corners, where heights change linearly."""
    own = triangle_polygons(parcel(spark, d), "bsm")
    return fusion.dissolved(own, box_polygons(zone(spark, d), "zone_id"), 512.0, "area").withColumn("area", F.round("area", 4))


@query(", burnt AS (SELECT x.row, x.col, max(z.zone_id) AS zone_id, any_value(x.z) AS z FROM pixel x JOIN zone z ON (x.col + 0.5) * 100 >= z.x0 AND (x.row + 0.5) * 100 >= z.y0 AND ((x.col + 0.5) * 100 - z.x0) * (z.y1 - z.y0) + ((x.row + 0.5) * 100 - z.y0) * (z.x1 - z.x0) < (z.x1 - z.x0) * (z.y1 - z.y0) WHERE x.z > 0 GROUP BY x.row, x.col) SELECT zone_id, round(avg(z), 6) AS mean, max(z) AS max, count(*) AS n FROM burnt GROUP BY zone_id", "pixel", "zone")
def polygon_zonal_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the raster cells whose centre the lower left half of each zone holds."""
    cells = pixel(spark, d).where("z > 0").select("row", "col", "z", ((F.col("col") + 0.5) * 100).alias("px"), ((F.col("row") + 0.5) * 100).alias("py"))
    return polygons.zonal(cells, triangle_polygons(zone(spark, d), "zone_id"), "zone_id").withColumn("mean", F.round("mean", 6))


@query(", s AS (SELECT block, least(ax, bx) AS ax, CASE WHEN ax < bx OR (ax = bx AND ay <= ey) THEN ay ELSE ey END AS ay, greatest(ax, bx) AS bx, CASE WHEN ax < bx OR (ax = bx AND ay <= ey) THEN ey ELSE ay END AS ey FROM (SELECT block, x0 AS ax, y0 AS ay, x1 AS bx, y0 AS ey FROM swap WHERE type_code > 0 UNION ALL SELECT block, x1, y0, x1, y1 FROM swap WHERE type_code > 0 UNION ALL SELECT block, x0, y1, x1, y1 FROM swap WHERE type_code > 0 UNION ALL SELECT block, x0, y0, x0, y1 FROM swap WHERE type_code > 0)), o AS (SELECT block, sum(len) AS p FROM (SELECT block, sqrt((ax - bx) * (ax - bx) + (ay - ey) * (ay - ey)) AS len, count(*) AS n FROM s GROUP BY block, ax, ay, bx, ey HAVING count(*) = 1) GROUP BY block) SELECT block, round(4 * pi() * a / (p * p), 6) AS compactness FROM o JOIN (SELECT block, sum(area_m2) AS a FROM swap WHERE type_code > 0 GROUP BY block) USING (block)", "swap")
def polygon_compactness(spark: SparkSession, d: str) -> DataFrame:
    """Compactness of blocks from the outlines of their polygons."""
    s = swap(spark, d).where("type_code > 0")
    own = box_polygons(s, "bsm").join(s.select("bsm", "block"), "bsm")
    return polygons.block_compactness(own).withColumn("compactness", F.round("compactness", 6))


def _bad(spark: SparkSession, d: str) -> DataFrame:
    """Parcels whose outline crosses itself, has a spike, a hole that touches the outline at a corner or along a side."""
    p = parcel(spark, d).select("bsm", *(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))).withColumns({"xm": F.expr("(x0 + x1) / 2"), "ym": F.expr("(y0 + y1) / 2"), "top": F.col("y1") + 40, "xq": F.expr("x0 + 25"), "yq": F.expr("y0 + 25")})
    kinds = [
        rings(p.where("bsm % 5 = 0"), "bsm", ("x0", "y0"), ("x1", "y1"), ("x1", "y0"), ("x0", "y1")),
        rings(p.where("bsm % 5 = 1"), "bsm", ("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("xm", "y1"), ("xm", "top"), ("xm", "y1"), ("x0", "y1")),
        rings(p.where("bsm % 5 = 2"), "bsm", ("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "ym"), ("xm", "yq"), ("xm", "ym"), hole=3),
        rings(p.where("bsm % 5 = 3"), "bsm", ("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"), ("xq", "y0"), ("xq", "yq"), ("x0", "yq"), hole=4),
        rings(p.where("bsm % 5 = 4"), "bsm", ("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")),
    ]
    return reduce(DataFrame.unionByName, kinds)


@query("SELECT bsm, [5000.0, 10000, 9375, 9375, 10000][bsm % 5 + 1]::DOUBLE AS area, round([200 + 200 * sqrt(2), 400.0, 400 + 25 + sqrt(50 * 50 + 25 * 25) + 50, 400, 400][bsm % 5 + 1], 6)::DOUBLE AS length, [2, 1, 1, 1, 1][bsm % 5 + 1]::BIGINT AS n_polygons, [2, 1, 2, 1, 1][bsm % 5 + 1]::BIGINT AS n_rings, bsm % 5 <> 4 AS changed FROM parcel", "parcel")
def repaired_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Outlines that are not valid, made valid."""
    made = polygons.made_valid(_bad(spark, d), "bsm")
    return made.select("bsm", F.round("area", 6).alias("area"), F.round("length", 6).alias("length"), "n_polygons", "n_rings", "changed")


@query(", s AS (SELECT bsm, CASE WHEN bsm % 3 = 0 THEN 0.4 ELSE 99.7 END AS h FROM parcel) SELECT bsm, 10000.0::DOUBLE AS area, 400.0::DOUBLE AS length FROM s WHERE h > 1", "parcel")
def snapped_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Outlines on a grid of whole metres: jitter goes, and slivers that are narrower vanish."""
    p = parcel(spark, d).select("bsm", *(F.expr(e).alias(c) for c, e in (("a", "x0 + 0.3D"), ("b", "x1 - 0.4D"), ("c", "y0 - 0.2D"), ("e", "CASE WHEN bsm % 3 = 0 THEN y0 + 0.2D ELSE y1 - 0.3D END"), ("m", "(x0 + x1) / 2 + 0.1D"), ("n", "y0 + 0.4D"))))
    return polygons.made_valid(rings(p, "bsm", ("a", "c"), ("m", "c"), ("m", "n"), ("m", "c"), ("b", "c"), ("b", "e"), ("a", "e")), "bsm", 0).select("bsm", "area", "length")


_SIDES = ", s AS (SELECT block, x0 AS ax, y0 AS ay, x1 AS bx, y0 AS ey, 1 AS w FROM swap WHERE type_code > 0 UNION ALL SELECT block, x1, y0, x1, y1, 1 FROM swap WHERE type_code > 0 UNION ALL SELECT block, x0, y1, x1, y1, 1 FROM swap WHERE type_code > 0 UNION ALL SELECT block, x0, y0, x0, y1, 1 FROM swap WHERE type_code > 0), o AS (SELECT block, sum(len) AS length FROM (SELECT block, CASE WHEN ax = bx THEN ey - ay ELSE bx - ax END AS len FROM s GROUP BY block, ax, ay, bx, ey HAVING count(*) = 1) GROUP BY block)"
_REACH = ", t AS (SELECT block, gcol, grow FROM swap WHERE type_code > 0), r AS (SELECT block, gcol, grow, gcol AS c, grow AS g FROM t UNION SELECT t.block, t.gcol, t.grow, r.c, r.g FROM r JOIN t ON t.block = r.block AND abs(t.gcol - r.gcol) + abs(t.grow - r.grow) = 1), k AS (SELECT block, count(DISTINCT first) AS n_polygons FROM (SELECT block, gcol, grow, min(g * 100 + c) AS first FROM r GROUP BY ALL) GROUP BY block)"


@query(_SIDES + _REACH + " SELECT block, sum(area_m2) AS area, any_value(length)::DOUBLE AS length, any_value(n_polygons)::BIGINT AS n_polygons, count(*) AS n_parcels FROM swap JOIN o USING (block) JOIN k USING (block) WHERE type_code > 0 GROUP BY block", "swap")
def dissolve_units(spark: SparkSession, d: str) -> DataFrame:
    """Union of the swappable parcels of each block: area, outline and separate parts."""
    s = swap(spark, d).where("type_code > 0")
    own = box_polygons(s, "bsm").join(s.select("bsm", "block"), "bsm")
    return polygons.dissolve(own, ["block"]).select("block", "area", "length", "n_polygons", "n_parcels")


@query(", c AS (SELECT CASE WHEN bsm % 2 = 0 THEN qsdwdm ELSE substr(qsdwdm, 1, 9) END AS code, bsm FROM parcel) SELECT code AS XZQDM, 'N' || code AS XZQMC, CASE WHEN length(code) >= 12 THEN 'village' ELSE 'township' END AS admin_level, substr(code, 1, 9) AS admin_parent_code, count(*) * 10000.0::DOUBLE AS area, count(*) AS n_parcels FROM c GROUP BY code", "parcel")
def admin_proxy(spark: SparkSession, d: str) -> DataFrame:
    """Units by code and name, dissolved from the parcels where no layer of units is given."""
    p = parcel(spark, d)
    code = F.when(F.col("bsm") % 2 == 0, F.col("qsdwdm")).otherwise(F.substring("qsdwdm", 1, 9))
    named = p.select("bsm", code.alias("qsdwdm"), F.concat(F.lit("N"), code).alias("qsdwmc"))
    return polygons.admin_proxy(box_polygons(p, "bsm").join(named, "bsm")).select("XZQDM", "XZQMC", "admin_level", "admin_parent_code", "area", "n_parcels")


_UNITS = f", u AS (SELECT zone_id AS unit_id, CASE zone_id % 3 WHEN 0 THEN '500120' ELSE '511011.0' END AS county_code, * FROM zone WHERE zone_id % 3 <> 0), ov AS (SELECT u.unit_id, substr(p.qsdwdm, 1, 9) AS code, (least(p.x1, u.x1) - greatest(p.x0, u.x0)) * (least(p.y1, u.y1) - greatest(p.y0, u.y0)) AS area FROM parcel p JOIN u ON p.x0 < u.x1 AND u.x0 < p.x1 AND p.y0 < u.y1 AND u.y0 < p.y1), b AS (SELECT unit_id, code, row_number() OVER (PARTITION BY unit_id ORDER BY round(area, 6) DESC, code) AS k FROM ov)"


@query(_UNITS + " SELECT u.unit_id, 'N' || u.unit_id AS XZQMC, coalesce(b.code, '') AS XZQDM, CASE WHEN b.code IS NULL THEN 'UNAVAILABLE' ELSE 'DLTB_DOMINANT_OVERLAP' END AS code_source, '511011' AS admin_parent_code FROM u LEFT JOIN b ON b.unit_id = u.unit_id AND b.k = 1", "parcel", "zone")
def reference_units(spark: SparkSession, d: str) -> DataFrame:
    """Units of the parcels' county from a layer of several counties, with the code that covers most of each."""
    z = zone(spark, d)
    county = F.when(F.col("zone_id") % 3 == 0, "500120").otherwise("511011.0")
    layer = box_polygons(z, "zone_id").join(z.select("zone_id", county.alias("county_code"), F.concat(F.lit("N"), F.col("zone_id").cast("string")).alias("XZQMC")), "zone_id").withColumnRenamed("zone_id", "unit_id")
    p = parcel(spark, d)
    own = box_polygons(p, "bsm").join(p.select("bsm", "qsdwdm"), "bsm")
    return polygons.build_admin_units(own, layer).select("unit_id", "XZQMC", "XZQDM", "code_source", "admin_parent_code")
