"""Polygon geometry on WKB with NumPy: rings, area, length, centroid, containment, interior point, repair.

A geometry is a list of polygons; a polygon is a list of closed rings (n, 2), the outer first.
"""

from __future__ import annotations

import struct

import numpy as np

Polygons = list[list[np.ndarray]]


def from_wkb(raw: bytes) -> Polygons:
    """Polygons of a WKB polygon, multipolygon or collection (other members are left out); Z and M are dropped."""
    out: Polygons = []
    _read(raw, 0, out)
    return out


def _read(raw: bytes, at: int, out: Polygons) -> int:
    order = "<" if raw[at] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", raw, at + 1)
    at += 5
    if code & 0x20000000:
        at += 4  # SRID of the extended form
    dims = 2 + bool(code & 0x80000000 or (code & 0xFFFF) // 1000 in (1, 3)) + bool(code & 0x40000000 or (code & 0xFFFF) // 1000 in (2, 3))
    kind = (code & 0xFFFF) % 1000
    points = lambda n, p: np.frombuffer(raw, order + "f8", n * dims, p).reshape(n, dims)[:, :2].astype(float)
    if kind == 1:
        return at + 8 * dims
    (n,) = struct.unpack_from(order + "I", raw, at)
    at += 4
    if kind == 2:
        return at + 8 * dims * n
    if kind == 3:
        rings = []
        for _ in range(n):
            (k,) = struct.unpack_from(order + "I", raw, at)
            rings.append(points(k, at + 4))
            at += 4 + 8 * dims * k
        if rings:
            out.append(rings)
        return at
    for _ in range(n):
        at = _read(raw, at, out)
    return at


def to_wkb(polygons: Polygons) -> bytes:
    """A polygon, or a multipolygon unless there is exactly one."""
    one = lambda rings: struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + np.ascontiguousarray(r, "<f8").tobytes() for r in rings)
    if len(polygons) == 1:
        return one(polygons[0])
    return struct.pack("<BII", 1, 6, len(polygons)) + b"".join(map(one, polygons))


def signed_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum()) / 2


def area(polygons: Polygons) -> float:
    return sum(abs(signed_area(p[0])) - sum(abs(signed_area(h)) for h in p[1:]) for p in polygons)


def length(polygons: Polygons) -> float:
    return float(sum(np.hypot(*np.diff(r, axis=0).T).sum() for p in polygons for r in p))


def bounds(polygons: Polygons) -> tuple[float, float, float, float]:
    xy = np.concatenate([p[0] for p in polygons])
    return (*map(float, xy.min(0)), *map(float, xy.max(0)))


def centroid(polygons: Polygons) -> tuple[float, float]:
    total, moment = 0.0, np.zeros(2)
    for p in polygons:
        for i, r in enumerate(p):
            o = r[0]
            q = r - o
            cross = q[:-1, 0] * q[1:, 1] - q[1:, 0] * q[:-1, 1]
            a = cross.sum() / 2
            if a == 0:
                continue
            c = ((q[:-1] + q[1:]) * cross[:, None]).sum(0) / (6 * a) + o
            weight = abs(a) * (1 if i == 0 else -1)
            total, moment = total + weight, moment + weight * c
    if total == 0:
        return tuple(map(float, np.concatenate([p[0] for p in polygons]).mean(0)))
    return tuple(map(float, moment / total))


def contains(polygons: Polygons, x: float, y: float) -> bool:
    """Even-odd rule over all rings."""
    inside = False
    for p in polygons:
        for r in p:
            a, b = r[:-1], r[1:]
            cross = (a[:, 1] > y) != (b[:, 1] > y)
            if cross.any():
                a, b = a[cross], b[cross]
                inside ^= bool(((b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0] > x).sum() % 2)
    return inside


def contains_all(polygons: Polygons, xy: np.ndarray) -> np.ndarray:
    """The even-odd rule for many points, ring by ring."""
    inside = np.zeros(len(xy), bool)
    for p in polygons:
        for r in p:
            for at in range(0, len(xy), max(1, (1 << 20) // len(r))):  # bounds the arrays
                x, y = xy[at : at + max(1, (1 << 20) // len(r))].T[:, :, None]
                a, b = r[:-1], r[1:]
                cross = (a[:, 1] > y) != (b[:, 1] > y)
                with np.errstate(divide="ignore", invalid="ignore"):
                    left = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0] > x
                inside[at : at + len(x)] ^= (cross & left).sum(1) % 2 == 1
    return inside


def to_geojson(polygons: Polygons) -> dict:
    """The geometry object of a feature."""
    rings = [[r.tolist() for r in p] for p in polygons]
    return {"type": "Polygon", "coordinates": rings[0]} if len(rings) == 1 else {"type": "MultiPolygon", "coordinates": rings}


def interior_point(polygons: Polygons) -> tuple[float, float]:
    """Middle of the widest inside run on the horizontal line between two vertex heights near the middle."""
    ys = np.unique(np.concatenate([r[:, 1] for p in polygons for r in p]))
    if len(ys) < 2:
        return centroid(polygons)
    heights = (ys[:-1] + ys[1:]) / 2
    for y in heights[np.argsort(np.abs(heights - (ys[0] + ys[-1]) / 2))]:
        xs = []
        for p in polygons:
            for r in p:
                a, b = r[:-1], r[1:]
                m = (a[:, 1] > y) != (b[:, 1] > y)
                xs.append(a[m, 0] + (y - a[m, 1]) * (b[m, 0] - a[m, 0]) / (b[m, 1] - a[m, 1]))
        x = np.sort(np.concatenate(xs))
        if len(x):
            k = int(np.argmax(x[1::2] - x[::2]))
            return float((x[2 * k] + x[2 * k + 1]) / 2), float(y)
    return centroid(polygons)


def closed(polygons: Polygons) -> Polygons:
    """Rings closed, points that are repeated or not finite dropped, rings of fewer than three points dropped."""
    out = []
    for p in polygons:
        rings = []
        for r in p:
            r = r[np.isfinite(r).all(1)]
            if len(r) and (r[0] != r[-1]).any():
                r = np.vstack([r, r[:1]])
            r = r[np.concatenate([[True], (np.diff(r, axis=0) != 0).any(1)])] if len(r) else r
            rings.append(r if len(r) >= 4 else r[:0])
        out.append(rings)
    return out


def repair(polygons: Polygons) -> Polygons:
    """Closed rings, those without area dropped, outer rings counter-clockwise, holes clockwise; crossings stay."""
    out = []
    for p in closed(polygons):
        rings = []
        for i, r in enumerate(p):
            if not len(r) or (a := signed_area(r)) == 0:
                if i == 0:
                    break
                continue
            rings.append(r if (a > 0) == (i == 0) else r[::-1])
        if rings:
            out.append(rings)
    return out


def simplify(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Points farther than the tolerance from the line of their neighbours that stay; a ring keeps four points."""
    keep = np.zeros(len(ring), bool)
    keep[[0, len(ring) // 2, -1]] = True
    stack = [(0, len(ring) // 2), (len(ring) // 2, len(ring) - 1)]
    while stack:
        i, j = stack.pop()
        if j <= i + 1:
            continue
        d = ring[j] - ring[i]
        q = ring[i + 1 : j] - ring[i]
        n = np.hypot(*d)
        dist = np.abs(q[:, 0] * d[1] - q[:, 1] * d[0]) / n if n else np.hypot(*q.T)
        k = int(dist.argmax())
        if dist[k] > tolerance:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    out = ring[keep]
    return out if len(out) >= 4 else ring


def utm_zone(lon: float, lat: float) -> int:
    """EPSG code of the UTM zone of a geographic position."""
    return (32600 if lat >= 0 else 32700) + min(int((lon + 180) // 6) + 1, 60)


def to_utm(lon: np.ndarray, lat: np.ndarray, epsg: int) -> tuple[np.ndarray, np.ndarray]:
    """Easting and northing on WGS 84 by the Krueger series of third order."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    big = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    lam = np.radians(np.asarray(lon, float) - ((epsg % 100) * 6 - 183))
    phi = np.radians(np.asarray(lat, float))
    e = 2 * np.sqrt(n) / (1 + n)
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    x = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(alpha, 1))
    y = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(alpha, 1))
    return 500_000 + 0.9996 * big * x, 0.9996 * big * y + (10_000_000 if epsg // 100 == 327 else 0)


def _segments(polygons: Polygons) -> np.ndarray:
    """(n, 4) x0, y0, x1, y1 with x0 < x1; vertical edges bound no area between two heights and drop out."""
    s = [np.hstack([r[:-1], r[1:]]) for p in polygons for r in p]
    s = np.concatenate(s) if s else np.zeros((0, 4))
    s = s[s[:, 0] != s[:, 2]]
    turn = s[:, 0] > s[:, 2]
    s[turn] = s[turn][:, [2, 3, 0, 1]]
    return s


def _runs(seg: np.ndarray, x: float) -> list[tuple[float, float]]:
    """Inside runs on the vertical line at x, by the even-odd rule."""
    m = (seg[:, 0] < x) & (seg[:, 2] > x)
    a = seg[m]
    y = np.sort(a[:, 1] + (x - a[:, 0]) * (a[:, 3] - a[:, 1]) / (a[:, 2] - a[:, 0]))
    return list(zip(y[::2], y[1::2], strict=False))


def overlap_area(shape: Polygons, others: list[Polygons]) -> float:
    """Area of shape that any of the others covers, counted once.

    Vertical slabs end at every vertex and every crossing of two edges. Inside a slab
    no edges cross, so covered heights change linearly and the slab's middle gives
    its exact area.
    """
    own, covers = _segments(shape), [_segments(o) for o in others]
    if not len(own) or not covers:
        return 0.0
    lo, hi = own[:, 0].min(), own[:, 2].max()
    every = np.concatenate([own, *covers])
    every = every[(every[:, 0] < hi) & (every[:, 2] > lo)]
    # edges wholly above or below the shape bound no height inside it, so that their crossings cut no slabs
    ends, low, high = every[:, [0, 2]].ravel(), own[:, [1, 3]].min(), own[:, [1, 3]].max()
    every = every[(np.maximum(every[:, 1], every[:, 3]) >= low) & (np.minimum(every[:, 1], every[:, 3]) <= high)]
    slope = (every[:, 3] - every[:, 1]) / (every[:, 2] - every[:, 0])
    base = every[:, 1] - slope * every[:, 0]
    ds = slope[:, None] - slope[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = (base[None, :] - base[:, None]) / ds
    ok = (ds != 0) & (cross > np.maximum(every[:, None, 0], every[None, :, 0])) & (cross < np.minimum(every[:, None, 2], every[None, :, 2]))
    xs = np.unique(np.concatenate([ends, cross[ok], [lo, hi]]))
    xs = xs[(xs >= lo) & (xs <= hi)]
    total = 0.0
    for a, b in zip(xs, xs[1:], strict=False):
        mid = (a + b) / 2
        runs = _runs(own, mid)
        if not runs:
            continue
        union: list[list[float]] = []
        for y0, y1 in sorted(r for c in covers for r in _runs(c, mid)):
            if union and y0 <= union[-1][1]:
                union[-1][1] = max(union[-1][1], y1)
            else:
                union.append([y0, y1])
        total += (b - a) * sum(max(0.0, min(y1, u1) - max(y0, u0)) for y0, y1 in runs for u0, u1 in union)
    return float(total)
