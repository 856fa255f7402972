"""Polygons by grid cells, so that a join reads one cell's part of an outline and never the whole.

`side_index` has for each cell the sides that meet it and the state of its corner: a
point is located exactly from its own cell alone. `piece_index` has the part of a
polygon in each cell: areas of overlaps are sums over cells. Both grow with sides and
cells, whatever the number of pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.functions import geometry as G
from parcelspark.functions import predicates as P
from parcelspark.scratch import prepare

#: Rows of one Arrow batch that an index makes.
ROWS = 4096


def _indexed(df: DataFrame, key: str, schema: str, rows: Callable[[G.Polygons], Iterator[tuple]]) -> DataFrame:
    prepare(df.sparkSession)
    kind = dict(df.dtypes)[key]
    names = [key, *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch(kind: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c) for c in cols[1:])], names)

        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for row in rows(G.repair(G.from_wkb(raw))) if raw else ():
                    out.append((k, *row))
                    if len(out) >= ROWS:
                        yield batch(b.schema.field(0).type)
            if out:
                yield batch(b.schema.field(0).type)

    return df.select(key, "geometry").mapInArrow(run, f"{key} {kind}, {schema}")


def side_index(zones: DataFrame, key: str, cell: float) -> DataFrame:
    """key, cx, cy, corner (inside?) and sides (x, y of both ends, as bytes) of every cell that a polygon meets."""
    rows = lambda g: ((c, r, f, np.ascontiguousarray(s, "<f8").tobytes()) for c, r, f, s in P.cell_sides(g, cell))
    return _indexed(zones, key, "cx long, cy long, corner boolean, sides binary", rows)


def located(points: DataFrame, index: DataFrame, zone: str, cell: float) -> DataFrame:
    """zone, inside, edge and all columns but px, py of the points, for each polygon that holds them or whose boundary does.

    inside is the rule of pixel centres (left and lower edges belong to a polygon, so that
    neighbours share no point); `within` is inside AND NOT edge, `intersects` inside OR edge.
    """
    # the cells are those of the index, whose floor is taken on the same quotient
    spot = points.withColumns({"cx": F.floor(F.col("px") / cell), "cy": F.floor(F.col("py") / cell)})
    carried = [c for c in points.columns if c not in ("px", "py")]
    near = spot.join(index.select(F.col(zone).alias("__zone"), "cx", "cy", "corner", "sides"), ["cx", "cy"])
    near = near.select(*carried, F.col("__zone").alias(zone), "px", "py", "cx", "cy", "corner", "sides")
    n = len(carried) + 1
    kinds = dict(near.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, cx, cy = (b.column(n + i).to_numpy(zero_copy_only=False).astype(float) for i in range(4))
            raw = b.column(n + 5).to_pylist()
            s = np.frombuffer(b"".join(raw), "<f8").reshape(-1, 4)
            of = np.repeat(np.arange(len(raw)), [len(r) // 32 for r in raw])
            inside, edge = P.in_cells(x, y, cx * cell, cy * cell, b.column(n + 4).to_numpy(zero_copy_only=False), s, of)
            keep = pa.array(inside | edge)
            own = pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(inside), pa.array(edge)], [*b.schema.names[:n], "inside", "edge"])
            yield own.filter(keep)

    return near.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in (*carried, zone)) + ", inside boolean, edge boolean")


def piece_index(shapes: DataFrame, key: str, cell: float) -> DataFrame:
    """key, cx, cy, rings (WKB, even-odd), its area, bounds, full (the whole cell) and box (all of its bounds) for every cell that a polygon covers some of."""

    def rows(g: G.Polygons) -> Iterator[tuple]:
        for c, r, rings in P.cell_pieces(g, cell):
            area = G.area([[x] for x in rings]) if len(rings) == 1 else G.overlap_area([rings], [[rings]])
            if area > 0:
                x0, y0, x1, y1 = G.bounds([rings])
                yield c, r, G.to_wkb([rings]), float(area), x0, y0, x1, y1, bool(area >= cell * cell * (1 - 1e-12)), bool(area >= (x1 - x0) * (y1 - y0) * (1 - 1e-12))

    return _indexed(shapes, key, "cx long, cy long, rings binary, area double, x0 double, y0 double, x1 double, y1 double, full boolean, box boolean", rows)


def extent(index: DataFrame) -> tuple[float, float, float, float] | None:
    """Bounds of all pieces; none without any."""
    r = index.agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).first()
    return None if r[0] is None else tuple(r)


def _outside(raw: list[bytes | None], bounds: tuple[float, float, float, float]) -> np.ndarray:
    """Whether plain polygons of one ring lie beside the bounds; others are not looked at. Those of one size are read at once."""
    out = np.zeros(len(raw), bool)
    size = np.array([len(r) if r else 0 for r in raw])
    for n in np.unique(size[(size > 13) & (size % 16 == 13)]):
        at = np.flatnonzero(size == n)
        rows = np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), n)
        head = np.frombuffer(b"\x01\x03\x00\x00\x00\x01\x00\x00\x00" + int((n - 13) // 16).to_bytes(4, "little"), np.uint8)
        xy = np.ascontiguousarray(rows[:, 13:]).view("<f8").reshape(len(at), -1, 2)
        lo, hi = xy.min(1), xy.max(1)
        out[at] = (rows[:, :13] == head).all(1) & ((hi[:, 0] < bounds[0]) | (hi[:, 1] < bounds[1]) | (lo[:, 0] > bounds[2]) | (lo[:, 1] > bounds[3]))
    return out


def near(shapes: DataFrame, key: str, bounds: tuple[float, float, float, float] | None) -> DataFrame:
    """key, geometry without rows that share no land with anything inside the bounds, before their rings are read one by one."""
    if bounds is None:
        return shapes.select(key, "geometry").where("false")
    prepare(shapes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(~_outside(b.column(1).to_pylist(), bounds)))

    return shapes.select(key, "geometry").mapInArrow(run, f"{key} {dict(shapes.dtypes)[key]}, geometry binary")


def _covered(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys and area of `rings` that any of the list `others` covers; `area` where one covers the cell."""
    kinds = dict(pairs.dtypes)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, area = b.column(n + 3).to_pylist(), b.column(n + 2).to_pylist()
            out = [a if w else G.overlap_area(G.from_wkb(g), [G.from_wkb(x) for x in o]) for g, o, a, w in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist(), area, whole, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(out, pa.float64())], [*keys, "area"])

    return pairs.select(*keys, "rings", "others", "area", "full").mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", area double")


def _pairs(left: DataFrame, right: DataFrame, zone: str) -> DataFrame:
    """Pieces of both sides that lie in one cell and whose bounds meet; an outline that covers the left piece is not carried along.

    known: the area that both share, where their bounds say it.
    """
    both = left.alias("l").join(right.alias("r"), F.expr("l.cx = r.cx AND l.cy = r.cy AND l.x0 < r.x1 AND r.x0 < l.x1 AND l.y0 < r.y1 AND r.y0 < l.y1"))
    covers = F.expr("r.full OR (r.box AND r.x0 <= l.x0 AND r.y0 <= l.y0 AND r.x1 >= l.x1 AND r.y1 >= l.y1)")
    known = F.when(covers, F.col("l.area")).when(F.expr("l.box AND r.box"), F.expr("(least(l.x1, r.x1) - greatest(l.x0, r.x0)) * (least(l.y1, r.y1) - greatest(l.y0, r.y0))"))
    return both.select("l.*", F.col(f"r.{zone}").alias("__zone"), F.when(~covers, F.col("r.rings")).alias("other"), covers.alias("covers"), known.alias("known"))


def overlaps(left: DataFrame, right: DataFrame, key: str, zone: str) -> DataFrame:
    """key, zone, area of all pairs that share land; left and right: piece indexes of one cell size."""
    pairs = _pairs(left, right.withColumnRenamed(zone, "__key"), "__key").withColumnRenamed("__zone", zone)
    there = F.col("known").isNotNull()
    # what is known passes without its outlines
    pairs = pairs.withColumns({"others": F.when(~there, F.array("other")), "rings": F.when(~there, F.col("rings")), "area": F.coalesce("known", "area"), "full": there})
    return _covered(pairs, [key, zone]).groupBy(key, zone).agg(F.sum("area").alias("area")).where("area > 0")


def covered(left: DataFrame, right: DataFrame, key: str, zone: str) -> DataFrame:
    """key, area of the land that any polygon of right covers, counted once. A cell's list holds the pieces in that cell alone."""
    pairs = _pairs(left, right.withColumnRenamed(zone, "__key"), "__key")
    met = pairs.groupBy(key, "cx", "cy").agg(F.first("rings").alias("rings"), F.first("area").alias("area"), F.max("covers").alias("full"), F.collect_list("other").alias("others"))
    return _covered(met, [key]).groupBy(key).agg(F.sum("area").alias("area")).where("area > 0")
