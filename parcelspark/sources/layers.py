"""Which layer of a container has which role, and its columns under plain names."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.sources import files, geopackage


class LayerError(ValueError):
    """A role has no layer, or more than one."""


@dataclass(frozen=True)
class Role:
    """Parts of layer names (100 points each), and columns: names in the sources, and points for having one."""

    hints: list[str]
    columns: dict[str, tuple[list[str], int]]
    required: list[str]


# Hints, column names and points of each role.
ROLES = {
    "parcels": Role(
        ["dltb", "地类图斑", "2025地类"],
        {
            "bsm": (["BSM", "标识码"], 20),
            "dlbm": (["DLBM", "地类编码"], 30),
            "dlmc": (["DLMC", "地类名称"], 0),
            "qsdwdm": (["QSDWDM", "权属单位代码", "ZLDWDM", "坐落单位代码"], 25),
            "qsdwmc": (["QSDWMC", "权属单位名称", "ZLDWMC", "坐落单位名称"], 0),
        },
        ["bsm", "dlbm", "qsdwdm"],
    ),
    "pdt": Role(["pdt", "坡度"], {"pdjb": (["PDJB", "坡度级别"], 40), "bzpdjb": (["BZPDJB", "标准坡度级别"], 20)}, []),
    "eco": Role(["stbhhx", "生态保护红线", "生态红线"], {"lhdm": (["LHDM", "红线代码"], 15), "lhlx": (["LHLX", "红线类型"], 15)}, []),
    "pbf": Role(["yjjbntbhtb", "yjjbnttb", "yjjbnt", "永久基本农田", "基本农田"], {}, []),
}


def plain(name: str) -> str:
    """A name without white space, underscores, hyphens and brackets, in lower case."""
    return re.sub(r"[\s_\-()（）]", "", name).casefold()


def score(role: str, name: str, fields: list[str]) -> int:
    """Points of a layer for a role."""
    have, r = {plain(f) for f in fields}, ROLES[role]
    named = 100 * sum(plain(h) in plain(name) for h in r.hints)
    return named + sum(points for names, points in r.columns.values() if have & {plain(n) for n in names})


def select_layer(layers: list[tuple[str, str, list[str]]], role: str, explicit: str | None = None) -> str:
    """The layer for a role among (name, geometry type, fields): the named one, the only polygon layer, or the best of them."""
    if explicit is not None:
        if explicit not in [name for name, _, _ in layers]:
            raise LayerError(f"no layer {explicit}; there are {sorted(name for name, _, _ in layers)}")
        return explicit
    shapes = [(name, fields) for name, kind, fields in layers if "polygon" in kind.lower()]
    if len(shapes) == 1:
        return shapes[0][0]
    best = max((score(role, name, fields) for name, fields in shapes), default=0)
    found = sorted(name for name, fields in shapes if best > 0 and score(role, name, fields) == best)
    if len(found) != 1:
        raise LayerError(f"{role}: {'no layer' if not found else f'layers {found}'} of {sorted(n for n, _ in shapes)}; name one")
    return found[0]


def select_layers(spark: SparkSession, path: str, explicit: dict[str, str] | None = None, roles: list[str] | None = None) -> dict[str, str]:
    """The layer of each role in one container."""
    known = [(r["layer"], r["geometry_type"], r["fields"]) for r in files.list_layers(spark, path).collect()]  # the layers of one file
    return {role: select_layer(known, role, (explicit or {}).get(role)) for role in roles or list(ROLES)}


def named_columns(layer: DataFrame, role: str, fields: list[str]) -> DataFrame:
    """fid, the role's columns that the layer has under their plain names (others null), geometry."""
    at = {plain(f): f for f in reversed(fields)}

    def column(names: list[str]) -> Column:
        real = next((at[plain(n)] for n in names if plain(n) in at), None)
        return F.lit(None).cast("string") if real is None else F.col("attrs")[real]

    missing = [c for c in ROLES[role].required if not any(plain(n) in at for n in ROLES[role].columns[c][0])]
    if missing:
        raise LayerError(f"{role}: no column for {missing} among {fields}")
    return layer.select("fid", *(column(names).alias(c) for c, (names, _) in ROLES[role].columns.items()), "geometry")


def read_role(spark: SparkSession, path: str, role: str, layer: str | None = None, where: str | None = None, counts: dict | None = None) -> DataFrame:
    """The layer of a role in a GeoPackage, with valid polygons and plain column names.

    where: a condition of SQL on the layer's attributes, answered inside the file. counts
    gets the observation of what was read, repaired and dropped, under the role's name.
    """
    known = [(r["layer"], r["geometry_type"], r["fields"]) for r in files.list_layers(spark, path).collect()]
    name = select_layer(known, role, layer)
    fields = next(f for n, _, f in known if n == name)
    shapes, seen = geopackage.read_polygon_layer(spark, path, name, role == "parcels", where)
    if counts is not None:
        counts[role] = seen
    return named_columns(shapes, role, fields)
