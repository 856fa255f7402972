"""Adjacency graphs: contiguity, blocks, neighbourhoods, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.operators.components import components


def queen_edges(parcels: DataFrame) -> DataFrame:
    """src, dst, ts, td in both directions for parcels that share a corner.

    Corners meet at most a handful of parcels, so the corner table is grouped once and
    pairs come from each corner's list; a pair is kept at the smallest corner that both
    have, so pairs are not exchanged to find repeats.
    """
    corner = F.explode(F.array_distinct(F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x in ("x0", "x1") for y in ("y0", "y1")))))
    at = parcels.select(F.struct("bsm", "type_code", "x0", "y0", "x1", "y1").alias("p"), corner.alias("c")).groupBy("c").agg(F.collect_list("p").alias("ps"))
    one = at.select("c", "ps", F.explode("ps").alias("a")).select("c", "a", F.explode("ps").alias("b")).where("a.bsm <> b.bsm")
    first = lambda lo, hi: F.when(F.col(f"a.{lo}").isin(F.col(f"b.{lo}"), F.col(f"b.{hi}")), F.least(f"a.{lo}", F.when(F.col(f"a.{hi}").isin(F.col(f"b.{lo}"), F.col(f"b.{hi}")), F.col(f"a.{hi}")))).otherwise(F.col(f"a.{hi}"))
    once = one.where((F.col("c.x") == first("x0", "x1")) & (F.col("c.y") == first("y0", "y1")))
    return once.select(F.col("a.bsm").alias("src"), F.col("b.bsm").alias("dst"), F.col("a.type_code").alias("ts"), F.col("b.type_code").alias("td"))


def block_adjacency(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """bs, bd: blocks joined by an edge; blocks: bsm, block (rows without a block drop out)."""
    a = blocks.select(F.col("bsm").alias("src"), F.col("block").alias("bs"))
    b = blocks.select(F.col("bsm").alias("dst"), F.col("block").alias("bd"))
    return edges.select("src", "dst").join(a, "src").join(b, "dst").where("bs <> bd").select("bs", "bd").distinct()


def two_hop(edges: DataFrame) -> DataFrame:
    """src, dst within two steps, without itself."""
    e = edges.select("src", "dst")
    far = e.select("src", F.col("dst").alias("via")).join(e.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").where("src <> dst")
    return e.unionByName(far).distinct()


def links(parcels: DataFrame) -> DataFrame:
    """src, dst: at each corner the smallest parcel and every other one; enough to join what touches."""
    corner = F.explode(F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x in ("x0", "x1") for y in ("y0", "y1"))))
    at = parcels.select("bsm", corner.alias("c")).groupBy("c").agg(F.collect_list("bsm").alias("ps"))
    return at.where(F.size("ps") > 1).select(F.explode("ps").alias("src"), F.array_min("ps").alias("dst")).where("src <> dst")


def patches(parcels: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """root, area, n of each contiguous patch of farmland (single parcels too); edges: those of the parcels, if they are known."""
    farm = parcels.where("type_code = 1")
    joined = links(farm) if edges is None else edges.where("ts = 1 AND td = 1 AND src < dst").select("src", "dst")
    roots = components(joined)
    placed = farm.select("bsm", "area_m2").join(roots.withColumnRenamed("node", "bsm"), "bsm", "left").withColumn("root", F.coalesce("root", "bsm"))
    return placed.groupBy("root").agg(F.sum("area_m2").alias("area"), F.count("*").alias("n"))
