"""Views over the star-schema test tables in the shape of the land-parcel data model.

Parcels lie on a grid of 100 columns of 100 m cells keyed by o_orderkey; the same
text defines each view for the SQL that checks the DataFrame plans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.functions import codes
from parcelspark.functions import geometry as G
from parcelspark.scratch import ship

# The code of each residue of o_custkey.
PARCEL_CODES = ["0101", "0103", "0102", "0103A", "0301", "0305", "0307", "0201", "1104", "0601"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parcel(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    code = F.get(F.array(*map(F.lit, PARCEL_CODES)), (F.col("o_custkey") % 10).cast("int"))
    col, row = key % 100, F.floor(key / 100)
    price = F.col("o_totalprice")
    town = F.concat(F.lit("511011"), F.lpad(F.floor(key / 1000).cast("int").cast("string"), 3, "0"), F.lit("001"))
    return o.select(key.alias("bsm"), code.alias("dlbm"), town.alias("qsdwdm"), col.alias("gcol"), row.alias("grow"), (col * 100).alias("x0"), (row * 100).alias("y0"), (col * 100 + 100).alias("x1"), (row * 100 + 100).alias("y1"), (price - F.floor(price / 35.0) * 35.0).alias("slope_mean"))


def swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels with type, area, block of 10 x 10 cells, lock and swap flags."""
    p = parcel(spark, sf_dir)
    return p.withColumns({"type_code": codes.type_code(F.col("dlbm")), "area_m2": ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).cast("double"), "township": F.substring("qsdwdm", 1, 9), "block": F.floor(F.col("grow") / 10) * 10 + F.floor(F.col("gcol") / 10), "locked": F.col("bsm") % 13 == 0, "swapped": F.col("bsm") % 17 == 0})


def zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = (k * 137) % 9900, (k * 211) % 14000
    return table(spark, sf_dir, "supplier").select(k.cast("long").alias("zone_id"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + 50 + (k * 31) % 400).cast("double").alias("x1"), (y + 50 + (k * 17) % 400).cast("double").alias("y1"), (k % 5 + 1).alias("pdjb"))


def pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevation cells of 30 m on the same grid; each fiftieth has no data."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.floor(k / 100).alias("row"), (k % 100).alias("col"), F.when(F.col("o_custkey") % 50 == 0, -9999.0).otherwise(F.col("o_totalprice") / 1000).alias("z"))


def _single(xy: np.ndarray) -> pa.Array:
    """WKB polygons of one closed ring each, all of as many points: (rows, points, 2)."""
    n, k, _ = xy.shape
    head = np.frombuffer(G.to_wkb([[xy[0]]])[:13], np.uint8)
    raw = np.hstack([np.tile(head, (n, 1)), np.ascontiguousarray(xy, "<f8").reshape(n, -1).view(np.uint8)])
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * raw.shape[1]), pa.py_buffer(raw.tobytes())])


def rings(df: DataFrame, key: str, *corners: tuple[str, str], hole: int = 0) -> DataFrame:
    """key and geometry (WKB): the polygon with the given corner columns, in order; hole: so many of the last ones are a hole's."""
    ship(df.sparkSession)
    flat = [F.col(c).cast("double") for xy in corners for c in xy]

    def run(batches):
        for b in batches:
            xy = np.stack([b.column(i).to_numpy() for i in range(1, b.num_columns)], 1).reshape(b.num_rows, -1, 2)
            parts = [p for p in (xy[:, : xy.shape[1] - hole], xy[:, xy.shape[1] - hole :]) if p.shape[1]]
            if len(parts) == 1 and b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), _single(np.concatenate([parts[0], parts[0][:, :1]], 1))], [key, "geometry"])
                continue
            closed = [np.concatenate([p, p[:, :1]], 1) for p in parts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([G.to_wkb([list(r)]) for r in zip(*closed, strict=True)], pa.binary())], [key, "geometry"])

    # a small file is one task of the scan, while shapes are costly by the row
    rows = df.select(key, *(c.alias(f"c{i}") for i, c in enumerate(flat))).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    return rows.mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, geometry binary")


def box_polygons(df: DataFrame, key: str) -> DataFrame:
    return rings(df, key, ("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))


def triangle_polygons(df: DataFrame, key: str) -> DataFrame:
    """The lower left halves of boxes."""
    return rings(df, key, ("x0", "y0"), ("x1", "y0"), ("x0", "y1"))


def step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulation steps: episode, step from 1, value."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("episode"), F.row_number().over(w).alias("step"), F.col("value"), F.col("event_id").alias("unit_id"))


def unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restoration planning units on a grid of 50 columns."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("unit_id"), F.floor(k / 50).alias("row"), (k % 50).alias("col"), (F.col("p_size") % 3 != 0).cast("int").alias("candidate"), F.col("p_retailprice").alias("cost"), F.col("p_size").cast("double").alias("gain"), (k % 7 == 0).alias("selected"))


SQL_VIEWS = {
    "parcel": """SELECT o_orderkey AS bsm, CASE o_custkey % 10 WHEN 0 THEN '0101' WHEN 1 THEN '0103' WHEN 2 THEN '0102' WHEN 3 THEN '0103A' WHEN 4 THEN '0301' WHEN 5 THEN '0305' WHEN 6 THEN '0307' WHEN 7 THEN '0201' WHEN 8 THEN '1104' ELSE '0601' END AS dlbm,
 concat('511011', lpad(CAST(o_orderkey // 1000 AS VARCHAR), 3, '0'), '001') AS qsdwdm, o_orderkey % 100 AS gcol, o_orderkey // 100 AS grow,
 (o_orderkey % 100) * 100 AS x0, o_orderkey // 100 * 100 AS y0, (o_orderkey % 100) * 100 + 100 AS x1, o_orderkey // 100 * 100 + 100 AS y1, o_totalprice - floor(o_totalprice / 35.0) * 35.0 AS slope_mean FROM orders""",
    "swap": """SELECT *, CASE WHEN substr(dlbm, 1, 4) IN ('0101', '0102', '0103') THEN 1 WHEN dlbm IN ('0301', '0305', '0307') THEN 2 ELSE 0 END AS type_code,
 CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area_m2, substr(qsdwdm, 1, 9) AS township, grow // 10 * 10 + gcol // 10 AS block, bsm % 13 = 0 AS locked, bsm % 17 = 0 AS swapped FROM parcel""",
    "zone": """SELECT CAST(s_suppkey AS BIGINT) AS zone_id, CAST((s_suppkey * 137) % 9900 AS DOUBLE) AS x0, CAST((s_suppkey * 211) % 14000 AS DOUBLE) AS y0, CAST((s_suppkey * 137) % 9900 + 50 + (s_suppkey * 31) % 400 AS DOUBLE) AS x1, CAST((s_suppkey * 211) % 14000 + 50 + (s_suppkey * 17) % 400 AS DOUBLE) AS y1, s_suppkey % 5 + 1 AS pdjb FROM supplier""",
    "pixel": """SELECT o_orderkey // 100 AS row, o_orderkey % 100 AS col, CASE WHEN o_custkey % 50 = 0 THEN -9999.0 ELSE o_totalprice / 1000 END AS z FROM orders""",
    "step": """SELECT user_id AS episode, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value, event_id AS unit_id FROM events""",
    "unit": """SELECT p_partkey AS unit_id, p_partkey // 50 AS row, p_partkey % 50 AS col, CAST(p_size % 3 <> 0 AS INT) AS candidate, p_retailprice AS cost, CAST(p_size AS DOUBLE) AS gain, p_partkey % 7 = 0 AS selected FROM part""",
    "vtx": """SELECT bsm, type_code, x0 AS vx, y0 AS vy FROM swap WHERE type_code > 0 UNION ALL SELECT bsm, type_code, x1, y0 FROM swap WHERE type_code > 0 UNION ALL SELECT bsm, type_code, x0, y1 FROM swap WHERE type_code > 0 UNION ALL SELECT bsm, type_code, x1, y1 FROM swap WHERE type_code > 0""",
    "edge": """SELECT DISTINCT a.bsm AS src, b.bsm AS dst, a.type_code AS ts, b.type_code AS td FROM vtx a JOIN vtx b ON a.vx = b.vx AND a.vy = b.vy AND a.bsm <> b.bsm""",
}
NEEDS = {"swap": ["parcel"], "vtx": ["swap"], "edge": ["vtx"]}


def with_views(sql: str, *names: str) -> str:
    """sql after the common table expressions of the named views and of what they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in order) + ("" if sql.startswith(",") else " ") + sql
