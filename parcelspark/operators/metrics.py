"""Block, township and county features of parcels.

Parcels: bsm, block, township, type_code (1 farmland, 2 forest), slope_mean,
area_m2, swapped, locked. One pass over the parcels per level: conditional
aggregates, pre-aggregated before the only exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_farm() -> Column:
    return F.col("type_code") == 1


def is_forest() -> Column:
    return F.col("type_code") == 2


def is_free() -> Column:
    return ~F.col("swapped") & ~F.col("locked")


def weighted(slope: str, area: str, where: Column) -> Column:
    """Area-weighted mean of the rows that meet the condition; 0 if none does."""
    total = F.sum(F.when(where, F.col(area)))
    return F.coalesce(F.try_divide(F.sum(F.when(where, F.col(slope) * F.col(area))), total), F.lit(0.0))


def total(x: Column, where: Column) -> Column:
    return F.coalesce(F.sum(F.when(where, x)), F.lit(0.0))


def perimeter(parcels: DataFrame) -> DataFrame:
    """block, perimeter: sides that only one parcel of the block has."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    side = lambda a, b: F.struct(corner(*a).alias("a"), corner(*b).alias("b"))
    sides = F.explode(F.array(side(("x0", "y0"), ("x1", "y0")), side(("x0", "y1"), ("x1", "y1")), side(("x0", "y0"), ("x0", "y1")), side(("x1", "y0"), ("x1", "y1"))))
    once = parcels.select("block", sides.alias("s")).groupBy("block", "s").agg(F.count("*").alias("n")).where("n = 1")
    return once.groupBy("block").agg(F.sum(F.abs(F.col("s.a.x") - F.col("s.b.x")) + F.abs(F.col("s.a.y") - F.col("s.b.y"))).cast("double").alias("perimeter"))


def compactness(parcels: DataFrame) -> DataFrame:
    """block, compactness: 4 pi area / perimeter squared of the union."""
    area = parcels.groupBy("block").agg(F.sum("area_m2").alias("a"))
    return area.join(perimeter(parcels), "block").select("block", (4 * F.pi() * F.col("a") / F.pow("perimeter", F.lit(2))).alias("compactness"))


def block_features(parcels: DataFrame) -> DataFrame:
    """Counts, areas and weighted slopes of each block's farmland and forest."""
    return parcels.where(is_farm() | is_forest()).groupBy("block").agg(
        F.count("*").alias("n"),
        F.count_if(is_farm()).alias("n_farm"),
        F.count_if(is_forest()).alias("n_forest"),
        total(F.col("area_m2"), is_farm()).alias("farm_area"),
        total(F.col("area_m2"), is_forest()).alias("forest_area"),
        weighted("slope_mean", "area_m2", is_farm()).alias("farm_slope"),
        weighted("slope_mean", "area_m2", is_forest()).alias("forest_slope"),
    )


def block_state(parcels: DataFrame, block_edges: DataFrame, swaps_per_step: int = 5) -> DataFrame:
    """block, f0 to f16: the observation of each block (compactness as given by the parcels' outlines)."""
    own = parcels.where(is_farm() | is_forest())
    free_farm, free_forest = is_farm() & is_free(), is_forest() & is_free()
    s, a = F.col("slope_mean"), F.col("area_m2")
    square = F.coalesce(F.try_divide(F.sum(F.when(free_farm, s * s * a)), F.sum(F.when(free_farm, a))), F.lit(0.0))
    b = own.groupBy("block").agg(
        weighted("slope_mean", "area_m2", free_farm).alias("farm"),
        weighted("slope_mean", "area_m2", free_forest).alias("forest"),
        square.alias("farm2"),
        F.max(F.when(free_farm, s)).alias("top"),
        F.min(F.when(free_forest, s)).alias("bottom"),
        total(a, free_farm).alias("farm_free"),
        total(a, free_forest).alias("forest_free"),
        F.least(F.count_if(free_farm), F.count_if(free_forest)).alias("pairs"),
        F.count("*").alias("n"),
        (F.count_if("swapped") / 2).alias("swaps"),
        F.sum(a).alias("area"),
        total(a, is_farm()).alias("farm_area"),
        F.count_if("swapped").alias("n_swapped"),
    )
    ends = own.agg(F.min(s).alias("lo"), (1 / (F.max(s) - F.min(s) + 1e-8)).alias("inv"))
    widest = b.agg(F.max("area").alias("widest"))
    near = b.select(F.col("block").alias("bd"), (F.col("n_swapped") > 0).alias("inv_d"), F.col("farm_area").alias("farm_d"))
    around = block_edges.join(near, "bd").groupBy(F.col("bs").alias("block")).agg(F.count_if("inv_d").alias("k"), F.count("*").alias("adj"), F.sum("farm_d").alias("farm_near"))
    x = b.join(around, "block", "left").join(compactness(own), "block", "left").crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(widest))  # two rows
    lo, inv, w = F.col("lo"), F.col("inv"), F.col("widest")
    zero = F.lit(0.0)
    features = [
        (F.col("farm") - lo) * inv,
        (F.col("forest") - lo) * inv,
        (F.col("farm") - F.col("forest")) * inv,
        F.coalesce((F.col("top") - F.col("bottom")) * inv, zero),
        F.sqrt(F.greatest(F.col("farm2") - F.col("farm") * F.col("farm"), zero)) * inv,
        F.coalesce((F.col("top") - lo) * inv, zero),
        F.coalesce((F.col("bottom") - lo) * inv, zero),
        F.col("farm_free") / w,
        F.col("forest_free") / w,
        F.col("pairs") / F.col("n"),
        F.col("swaps") / swaps_per_step,
        F.coalesce("compactness", zero),
        F.col("area") / w,
        F.coalesce(F.col("k") / F.col("adj"), zero),
        F.coalesce(F.col("farm_near") / (w * F.col("adj")), zero),
        F.col("farm_area") / w,
        (F.col("n_swapped") > 0).cast("double"),
    ]
    return x.select("block", *(f.alias(f"f{i}") for i, f in enumerate(features)))


def greedy_pairs(parcels: DataFrame, nbrs: DataFrame, delta: float = 0.5, gamma: float = 1.0) -> DataFrame:
    """block, farm, forest: the best farm by slope less delta neighbours and forest by slope and gamma neighbours, where the farm is steeper.

    Only each block's best of either class can be the pair, so two ordered
    minima per block replace a join of all farms with all forests.
    """
    x = parcels.where((is_farm() | is_forest()) & is_free()).join(nbrs, "bsm", "left").withColumn("k", F.coalesce("farm_nbrs", F.lit(0)))
    best = x.groupBy("block").agg(
        F.max(F.when(is_farm(), F.struct((F.col("slope_mean") - delta * F.col("k")).alias("s"), (-F.col("bsm")).alias("b"), F.col("slope_mean").alias("v")))).alias("f"),
        F.min(F.when(is_forest(), F.struct((F.col("slope_mean") - gamma * F.col("k")).alias("s"), F.col("bsm").alias("b"), F.col("slope_mean").alias("v")))).alias("t"),
    )
    return best.where("f.v > t.v").select("block", (-F.col("f.b")).alias("farm"), F.col("t.b").alias("forest"), (F.col("f.v") - F.col("t.v")).alias("gain"))


def most_frequent(rows: DataFrame, column: str) -> DataFrame:
    """One row: the most frequent value that is neither null nor blank, of equals the smallest; null without one."""
    counts = rows.where(F.trim(F.col(column)) != "").groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min(F.struct((-F.col("n")).alias("n"), column)).alias("b")).select(F.col(f"b.{column}").alias(column))
