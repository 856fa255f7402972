"""Connected components of an edge table.

Edges are first contracted inside range partitions (union by minima over arrays),
which leaves at most one edge per node and partition; nodes that are near by number
mostly end in one partition. What is left goes through alternating large-star and
small-star steps: joins and pre-aggregated minima over narrow rows, one written
table per round, so lineage stays short. Nothing reaches the driver but two sums
that tell whether the edges still change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.scratch import drop, ship, stash


def smallest_labels(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component: minima over edges in both directions and pointer jumps."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, src, label[dst])
        np.minimum.at(new, dst, label[src])
        np.minimum.at(new, label[src], new[dst])  # hooks whole trees, not only their leaves
        np.minimum.at(new, label[dst], new[src])
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    u, v = t.column(0).to_numpy(), t.column(1).to_numpy()
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = nodes[smallest_labels(len(nodes), at[: len(u)], at[len(u) :])]
    m = root != nodes
    yield pa.RecordBatch.from_arrays([pa.array(nodes[m]), pa.array(root[m])], ["u", "v"])


def components(edges: DataFrame, src: str = "src", dst: str = "dst", partition_edges: int = 1_000_000) -> DataFrame:
    """(node, root) for every node of an edge; the root is the component's smallest node. Nodes are of type long.

    partition_edges bounds what one task contracts; a graph of no more edges is done with that.
    """
    spark = edges.sparkSession
    ship(spark)
    pairs = stash(edges.select(F.greatest(src, dst).cast("long").alias("u"), F.least(src, dst).cast("long").alias("v")).where("u <> v"), "edges")
    count = pairs.count()
    if count <= partition_edges:
        now = stash(pairs.coalesce(1).mapInArrow(_contract, "u long, v long"), "edges")
        drop(pairs)
        return _roots(now)
    now = stash(pairs.repartitionByRange(-(-count // partition_edges) + 1, "v", "u").mapInArrow(_contract, "u long, v long").distinct(), "edges")
    drop(pairs)
    sign = _sign(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(low.where("m < u").select(F.col("u").alias("a"), F.col("m").alias("b"))).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        small = stash(small, "edges")
        drop(now)
        now, before, sign = small, sign, _sign(small)
        if sign == before:
            break
    return _roots(now)


def _roots(now: DataFrame) -> DataFrame:
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
