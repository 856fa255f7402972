"""Spatial blocks: contiguous parts of a township, cut by Ward clustering under contiguity."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.operators.components import components
from parcelspark.scratch import ship


def constrained_ward(xy: np.ndarray, edges: list[tuple[int, int]], n_clusters: int) -> np.ndarray:
    """Labels 0.. after merging linked clusters with the smallest growth of the squared distances first."""
    n = len(xy)
    size, centre = {i: 1 for i in range(n)}, {i: xy[i].astype(float) for i in range(n)}
    near: dict[int, set[int]] = {i: set() for i in range(n)}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    cost = lambda a, b: size[a] * size[b] / (size[a] + size[b]) * float(((centre[a] - centre[b]) ** 2).sum())
    heap = [(cost(a, b), a, b) for a in near for b in near[a] if a < b]
    heapq.heapify(heap)
    label, alive, new = np.arange(n), n, n
    children: dict[int, list[int]] = {i: [i] for i in range(n)}
    while alive > n_clusters and heap:
        _, a, b = heapq.heappop(heap)
        if a not in size or b not in size:
            continue
        size[new], centre[new] = size[a] + size[b], (size[a] * centre[a] + size[b] * centre[b]) / (size[a] + size[b])
        near[new] = (near.pop(a) | near.pop(b)) - {a, b}
        children[new] = children.pop(a) + children.pop(b)
        del size[a], size[b], centre[a], centre[b]
        for x in near[new]:
            near[x] -= {a, b}
            near[x].add(new)
            heapq.heappush(heap, (cost(x, new), min(x, new), max(x, new)))
        alive, new = alive - 1, new + 1
    for k, members in enumerate(sorted(children.values(), key=min)):
        label[members] = k
    return label


def ward_blocks(parcels: DataFrame, edges: DataFrame, large: int = 30, per_cluster: int = 20, min_parcels: int = 3, min_ha: float = 0.5) -> DataFrame:
    """bsm, township, root, part: components of a township; those over `large` parcels are cut, too small ones dropped.

    A township is the unit of work, as in a county's data; its size does not grow with their number.
    """
    ship(parcels.sparkSession)
    town = parcels.select("bsm", "township", "area_m2", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    side = lambda k, t: town.select(F.col("bsm").alias(k), F.col("township").alias(t))
    inner = edges.select("src", "dst").join(side("src", "a"), "src").join(side("dst", "b"), "dst").where("a = b").select("src", "dst")
    roots = components(inner).withColumnRenamed("node", "bsm")
    placed = town.join(roots, "bsm", "left").withColumn("root", F.coalesce("root", "bsm"))
    near = inner.groupBy(F.col("src").alias("bsm")).agg(F.collect_list("dst").alias("near"))
    rows = placed.join(near, "bsm", "left")

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bsm").reset_index(drop=True)
        part = np.zeros(len(pdf), np.int64)
        if len(pdf) > large:
            at = {b: i for i, b in enumerate(pdf.bsm)}
            pairs = [(i, at[y]) for i, ys in enumerate(pdf.near) if ys is not None for y in ys]
            part = constrained_ward(pdf[["x", "y"]].to_numpy(), pairs, max(2, len(pdf) // per_cluster))
        out = pdf[["bsm", "township", "root"]].assign(part=part)
        good = pdf.groupby(part).area_m2.agg(["size", "sum"])
        ok = good.index[(good["size"] >= min_parcels) & (good["sum"] / 1e4 >= min_ha)]
        return out[out.part.isin(ok)]

    return rows.groupBy("root").applyInPandas(cut, "bsm long, township string, root long, part long")
