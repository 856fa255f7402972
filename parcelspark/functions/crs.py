"""Coordinate systems: well-known text, equality, metric choice, transverse Mercator and lengths on the ellipsoid.

A system is geographic or projected by transverse Mercator; both are kept as plain
parameters, from a code by the rules below or from well-known text of either version.
WGS 84, CGCS 2000 and ETRS 89 differ by less than a metre and count as one datum.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Semi-major axis and inverse flattening.
WGS84 = (6378137.0, 298.257223563)
GRS80 = (6378137.0, 298.257222101)

Node = tuple[str, list]
Transform = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


class CrsError(ValueError):
    """A coordinate system that is missing, unknown or not usable for the purpose."""


@dataclass(frozen=True)
class Crs:
    """lon0, lat0 (degrees), k0, east, north (in units) of a transverse Mercator projection; unit: metres, or degrees where geographic."""

    geographic: bool
    ellipsoid: tuple[float, float] = WGS84
    lon0: float = 0.0
    lat0: float = 0.0
    k0: float = 1.0
    east: float = 0.0
    north: float = 0.0
    unit: float = 1.0
    epsg: int | None = None

    def same(self, other: "Crs") -> bool:
        """By code where both have one, else by their parameters."""
        if self.epsg is not None and other.epsg is not None:
            return self.epsg == other.epsg
        mine, theirs = ((c.geographic, *c.ellipsoid, c.lon0, c.lat0, c.k0, c.east, c.north, c.unit) for c in (self, other))
        return all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(mine, theirs, strict=True))


def parse_epsg(text: str) -> int:
    """n of 'EPSG:n' or 'n'."""
    body = str(text).strip()
    body = body.split(":", 1)[1] if body.upper().startswith("EPSG:") else body
    try:
        return int(body)
    except ValueError as e:
        raise CrsError(f"{text!r} is not a code like EPSG:4326") from e


def from_epsg(code: int) -> Crs:
    """By the numbering of the public registry: geographic systems, UTM, and the national Gauss-Krueger zones."""
    if code in (4326, 4490, 4258):
        return Crs(True, WGS84 if code == 4326 else GRS80, epsg=code)
    if code // 100 in (326, 327) and 1 <= code % 100 <= 60:
        return Crs(False, WGS84, code % 100 * 6 - 183.0, 0.0, 0.9996, 500_000.0, 10_000_000.0 if code // 100 == 327 else 0.0, epsg=code)
    for first, last, base, width, zoned in ((4491, 4501, 13, 6, True), (4502, 4512, 13, 6, False), (4513, 4533, 25, 3, True), (4534, 4554, 25, 3, False)):
        if first <= code <= last:
            zone = base + code - first
            return Crs(False, GRS80, zone * width - (3.0 if width == 6 else 0.0), 0.0, 1.0, zone * 1e6 * zoned + 500_000.0, 0.0, epsg=code)
    raise CrsError(f"EPSG:{code} is not a system of this library")


def tree(wkt: str) -> Node:
    """Well-known text as (keyword, items): nested nodes, texts and numbers."""
    tokens = re.findall(r'"(?:[^"]|"")*"|[A-Za-z_0-9.+\-]+|[\[\](),]', wkt)
    at = 0

    def node() -> object:
        nonlocal at
        if at >= len(tokens):
            raise CrsError("the text of a coordinate system ends too early")
        t = tokens[at]
        at += 1
        if t.startswith('"'):
            return t[1:-1].replace('""', '"')
        if at < len(tokens) and tokens[at] in "[(":
            at += 1
            items = []
            while at < len(tokens) and tokens[at] not in "])":
                if tokens[at] == ",":
                    at += 1
                else:
                    items.append(node())
            at += 1
            return t.upper(), items
        try:
            return float(t)
        except ValueError:
            return t

    out = node()
    if not isinstance(out, tuple):
        raise CrsError(f"not the text of a coordinate system: {wkt[:40]!r}")
    return out


def _find(node: Node, *names: str) -> Node | None:
    """The first node with one of the names, level by level."""
    todo = [node]
    while todo:
        for n in todo:
            if n[0] in names:
                return n
        todo = [c for n in todo for c in n[1] if isinstance(c, tuple)]
    return None


def _plain(name: object) -> str:
    return re.sub(r"[\s_\-()]", "", str(name)).lower()


def from_wkt(wkt: str) -> Crs:
    root = tree(wkt)
    code = next((c for c in root[1] if isinstance(c, tuple) and c[0] in ("AUTHORITY", "ID") and str(c[1][0]).upper() == "EPSG"), None)
    epsg = int(float(code[1][1])) if code else None
    globe = _find(root, "SPHEROID", "ELLIPSOID")
    if globe is None:
        raise CrsError("a coordinate system without an ellipsoid")
    ellipsoid = (float(globe[1][1]), float(globe[1][2]))
    if root[0] in ("GEOGCS", "GEOGCRS", "GEODCRS", "GEOGRAPHICCRS"):
        return Crs(True, ellipsoid, epsg=epsg)
    if root[0] not in ("PROJCS", "PROJCRS", "PROJECTEDCRS"):
        raise CrsError(f"{root[0]} is neither geographic nor projected")
    method = _find(root, "PROJECTION", "METHOD")
    if method is None or _plain(method[1][0]) not in ("transversemercator", "gausskruger", "utm"):
        raise CrsError(f"projection {method[1][0] if method else None!r} is not transverse Mercator")
    values: dict[str, float] = {}
    todo = [root]
    while todo:
        n = todo.pop()
        if n[0] == "PARAMETER":
            values[_plain(n[1][0])] = float(n[1][1])
        todo += [c for c in n[1] if isinstance(c, tuple)]
    get = lambda *names: next((values[n] for n in names if n in values), 0.0)
    # of the units the one of lengths that belongs to the projection itself
    own = next((c for c in reversed(root[1]) if isinstance(c, tuple) and c[0] in ("UNIT", "LENGTHUNIT")), None) or _find(root, "LENGTHUNIT")
    return Crs(
        False,
        ellipsoid,
        get("centralmeridian", "longitudeofnaturalorigin"),
        get("latitudeoforigin", "latitudeofnaturalorigin"),
        get("scalefactor", "scalefactoratnaturalorigin") or 1.0,
        get("falseeasting"),
        get("falsenorthing"),
        float(own[1][1]) if own else 1.0,
        epsg,
    )


def parse(given: str | int | Crs) -> Crs:
    if isinstance(given, Crs):
        return given
    text = str(given).strip()
    return from_wkt(text) if "[" in text or "(" in text else from_epsg(parse_epsg(text))


def choose_metric(explicit: str | int | None, source: str | int | Crs, bounds: tuple[float, float, float, float]) -> Crs:
    """The given system, else a projected source's own, else the UTM zone of the middle of bounds; in metres."""
    own = parse(source)
    if explicit:
        out = parse(explicit)
    elif not own.geographic:
        out = own
    else:
        lon, lat = (bounds[0] + bounds[2]) / 2, (bounds[1] + bounds[3]) / 2
        out = from_epsg((32600 if lat >= 0 else 32700) + min(int((lon + 180) // 6) + 1, 60))
    if out.geographic:
        raise CrsError("a metric system must be projected")
    if not math.isclose(out.unit, 1.0, abs_tol=1e-9):
        raise CrsError(f"a metric system must use metres, not units of {out.unit} m")
    return out


def opaque(code: int) -> Crs:
    """A system that is known by its code alone: it equals itself, and nothing is transformed to or from it."""
    return Crs(False, k0=0.0, epsg=code)


def _series(c: Crs) -> tuple[float, float, tuple[float, ...], tuple[float, ...], float]:
    """n, radius of the rectifying sphere, and coefficients of the Krueger series both ways, to the fourth order."""
    a, inverse = c.ellipsoid
    f = 1 / inverse if inverse else 0.0
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    return n, big, alpha, beta, 2 * math.sqrt(n) / (1 + n)


def _conformal(phi: np.ndarray, e: float) -> np.ndarray:
    return np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))


def project(c: Crs, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Easting and northing in the system's units."""
    _, big, alpha, _, e = _series(c)

    def plane(lam: np.ndarray, phi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = _conformal(phi, e)
        xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
        x = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(alpha, 1))
        y = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(alpha, 1))
        return x, y

    x, y = plane(np.radians(np.asarray(lon, float) - c.lon0), np.radians(np.asarray(lat, float)))
    origin = plane(np.zeros(1), np.radians(np.array([c.lat0])))[1][0] if c.lat0 else 0.0
    return c.east + c.k0 * big * x / c.unit, c.north + c.k0 * big * (y - origin) / c.unit


def unproject(c: Crs, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude of a position."""
    _, big, alpha, beta, e = _series(c)
    origin = 0.0
    if c.lat0:
        xi0 = np.arctan(_conformal(np.radians(np.array([c.lat0])), e))
        origin = (xi0 + sum(a * np.sin(2 * j * xi0) for j, a in enumerate(alpha, 1)))[0]
    xi = (np.asarray(y, float) - c.north) * c.unit / (c.k0 * big) + origin
    eta = (np.asarray(x, float) - c.east) * c.unit / (c.k0 * big)
    xi1 = xi - sum(b * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, b in enumerate(beta, 1))
    eta1 = eta - sum(b * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, b in enumerate(beta, 1))
    want = np.sin(xi1) / np.sqrt(np.sinh(eta1) ** 2 + np.cos(xi1) ** 2)  # tangent of the conformal latitude
    t = want.copy()
    for _ in range(5):  # Newton steps
        sigma = np.sinh(e * np.arctanh(e * t / np.sqrt(1 + t * t)))
        got = t * np.sqrt(1 + sigma * sigma) - sigma * np.sqrt(1 + t * t)
        t = t + (want - got) / np.sqrt(1 + got * got) * (1 + (1 - e * e) * t * t) / ((1 - e * e) * np.sqrt(1 + t * t))
    return c.lon0 + np.degrees(np.arctan2(np.sinh(eta1), np.cos(xi1))), np.degrees(np.arctan(t))


def between(a: Crs, b: Crs) -> Transform:
    """Positions in a to positions in b, through longitude and latitude."""
    if a.same(b):
        return lambda x, y: (np.asarray(x, float), np.asarray(y, float))

    for c in (a, b):
        if not c.k0:
            raise CrsError(f"positions of EPSG:{c.epsg} cannot be transformed by this library")

    def run(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lon, lat = (np.asarray(x, float), np.asarray(y, float)) if a.geographic else unproject(a, x, y)
        return (lon, lat) if b.geographic else project(b, lon, lat)

    return run


def over_pole(lat: Column) -> tuple[Column, Column]:
    """The latitude between the poles of a position on a meridian's circle, and whether it is on the opposite meridian."""
    turned = F.pmod(lat + 90, F.lit(360.0)) - 90
    over = turned > 90
    return F.when(F.abs(lat) <= 90, lat).otherwise(F.when(over, 180 - turned).otherwise(turned)), over


def geodesic(lon1: Column, lat1: Column, lon2: Column, lat2: Column, ellipsoid: tuple[float, float] = WGS84, rounds: int = 12) -> Column:
    """Metres between two positions in degrees, by Vincenty's iteration (positions that are not nearly opposite).

    A latitude beyond a pole goes on down the opposite meridian.
    """
    a, inverse = ellipsoid
    f = 1 / inverse
    b = a * (1 - f)
    (lat1, over1), (lat2, over2) = (over_pole(x) for x in (lat1, lat2))
    lon1, lon2 = F.when(over1, lon1 + 180).otherwise(lon1), F.when(over2, lon2 + 180).otherwise(lon2)
    u1, u2 = (F.atan((1 - f) * F.tan(F.radians(x))) for x in (lat1, lat2))
    turn = F.radians(lon2 - lon1)
    s1, c1, s2, c2 = F.sin(u1), F.cos(u1), F.sin(u2), F.cos(u2)
    fixed = F.struct(s1.alias("s1"), c1.alias("c1"), s2.alias("s2"), c2.alias("c2"), turn.alias("turn"))

    def angles(k: Column, lam: Column) -> dict[str, Column]:
        x, y = k["c2"] * F.sin(lam), k["c1"] * k["s2"] - k["s1"] * k["c2"] * F.cos(lam)
        sin_s = F.sqrt(x * x + y * y)
        cos_s = k["s1"] * k["s2"] + k["c1"] * k["c2"] * F.cos(lam)
        sin_a = F.when(sin_s == 0, 0.0).otherwise(k["c1"] * k["c2"] * F.sin(lam) / sin_s)
        cos2 = 1 - sin_a * sin_a
        mid = F.when(cos2 == 0, 0.0).otherwise(cos_s - 2 * k["s1"] * k["s2"] / cos2)
        return {"sin_s": sin_s, "cos_s": cos_s, "sin_a": sin_a, "cos2": cos2, "mid": mid}

    def named(parts: dict[str, Column]) -> Column:
        return F.struct(*(v.alias(n) for n, v in parts.items()))

    # each round's angles are values of a struct, so that an expression is not repeated inside the next
    known = F.transform(F.array(fixed), lambda k: F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(k["turn"].alias("lam"), named(angles(k, k["turn"])).alias("g")), lambda s, _: F.get(F.transform(F.transform(F.array(s["g"]), lambda g: k["turn"] + _longer(g, f)), lambda lam: F.struct(lam.alias("lam"), named(angles(k, lam)).alias("g"))), F.lit(0)), lambda s: s["g"]))
    return F.get(F.transform(known, lambda g: _length(g, a, b)), F.lit(0))


def _length(g: Column, a: float, b: float) -> Column:
    """Metres of the arc with the angles g."""
    u = g["cos2"] * ((a * a - b * b) / (b * b))
    big_a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    big_b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    mid2 = 2 * g["mid"] * g["mid"] - 1
    delta = big_b * g["sin_s"] * (g["mid"] + big_b / 4 * (g["cos_s"] * mid2 - big_b / 6 * g["mid"] * (4 * g["sin_s"] * g["sin_s"] - 3) * (4 * g["mid"] * g["mid"] - 3)))
    return b * big_a * (F.atan2(g["sin_s"], g["cos_s"]) - delta)


def _longer(g: Column, f: float) -> Column:
    """How much longer the difference of longitudes is on the sphere than on the ellipsoid."""
    c = f / 16 * g["cos2"] * (4 + f * (4 - 3 * g["cos2"]))
    return (1 - c) * f * g["sin_a"] * (F.atan2(g["sin_s"], g["cos_s"]) + c * g["sin_s"] * (g["mid"] + c * g["cos_s"] * (2 * g["mid"] * g["mid"] - 1)))


def metres(lon1: float, lat1: float, lon2: float, lat2: float, ellipsoid: tuple[float, float] = WGS84) -> float:
    """The same length for one pair of positions."""
    a, f = ellipsoid[0], 1 / ellipsoid[1]
    b = a * (1 - f)
    u1, u2 = (math.atan((1 - f) * math.tan(math.radians(x))) for x in (lat1, lat2))
    turn = math.radians(lon2 - lon1)
    lam = turn
    for _ in range(50):
        sin_s = math.hypot(math.cos(u2) * math.sin(lam), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))
        if sin_s == 0:
            return 0.0
        cos_s = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        sin_a = math.cos(u1) * math.cos(u2) * math.sin(lam) / sin_s
        cos2 = 1 - sin_a**2
        mid = cos_s - 2 * math.sin(u1) * math.sin(u2) / cos2 if cos2 else 0.0
        c = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
        sigma = math.atan2(sin_s, cos_s)
        before, lam = lam, turn + (1 - c) * f * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
        if abs(lam - before) < 1e-14:
            break
    u = cos2 * (a * a - b * b) / (b * b)
    big_a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    big_b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    delta = big_b * sin_s * (mid + big_b / 4 * (cos_s * (2 * mid**2 - 1) - big_b / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
    return b * big_a * (sigma - delta)


def cell_metres(transform: tuple[float, float, float, float, float, float], crs: Crs, rows: int) -> tuple[float, float, str]:
    """Width and height of a raster's cells in metres, and how they were found.

    transform: x = a col + b row + c, y = d col + e row + f. Geographic cells are
    measured on the ellipsoid at the raster's middle latitude; rotated grids are refused.
    """
    a, b, c, d, e, f = transform
    if abs(b) > 1e-12 or abs(d) > 1e-12:
        raise CrsError("rotated grids must be made straight first")
    a, e = abs(a), abs(e)
    if not crs.geographic:
        return a * crs.unit, e * crs.unit, "horn_projected"
    lat = f - rows * e / 2
    return metres(c - a / 2, lat, c + a / 2, lat, crs.ellipsoid), metres(c, lat - e / 2, c, lat + e / 2, crs.ellipsoid), "horn_geographic_centre_latitude"
