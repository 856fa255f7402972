"""Exact predicates on points and sides.

The sign of a cross product in double precision is certain beyond a known bound of
its rounding; within the bound it is computed in rational numbers. Inside and
boundary follow from these signs alone, so `within`, `intersects` and the rule of
pixel centres differ only in what they say of the boundary.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np

#: Of the sum of both products: the bound of the rounding of a 2 x 2 determinant of differences.
_BOUND = (3 + 16 * 2.0**-53) * 2.0**-53


def orient(ax, ay, bx, by, px, py) -> np.ndarray:
    """1 where p lies to the left of the line from a to b, -1 to the right, 0 on it."""
    ax, ay, bx, by, px, py = np.broadcast_arrays(*(np.asarray(v, float) for v in (ax, ay, bx, by, px, py)))
    left, right = (bx - ax) * (py - ay), (by - ay) * (px - ax)
    det = left - right
    out = np.asarray(np.sign(det)).astype(np.int8)
    unsure = (np.abs(det) < _BOUND * (np.abs(left) + np.abs(right))) & ((px != bx) | (py != by))
    out = np.where((px == bx) & (py == by), np.int8(0), out)
    for i in map(tuple, np.argwhere(unsure)):
        a, b, c, d, x, y = (Fraction(float(v[i])) for v in (ax, ay, bx, by, px, py))
        exact = (c - a) * (y - b) - (d - b) * (x - a)
        out[i] = (exact > 0) - (exact < 0)
    return out


def beyond(s: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sides (n, 4) that pass height y do so to the right of x."""
    side = orient(s[:, 0], s[:, 1], s[:, 2], s[:, 3], x, y)
    return np.where(s[:, 3] > s[:, 1], side > 0, side < 0)


def above(s: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sides (n, 4) that pass just right of x do so above y; those through (x, y) where they rise."""
    back = s[:, 0] > s[:, 2]
    s = np.where(back[:, None], s[:, [2, 3, 0, 1]], s)
    side = orient(s[:, 0], s[:, 1], s[:, 2], s[:, 3], x, y)
    return (side < 0) | ((side == 0) & (s[:, 3] > s[:, 1]))


def touching(s: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sides (n, 4) hold the points (x, y), their ends included."""
    out = (np.minimum(s[:, 0], s[:, 2]) <= x) & (x <= np.maximum(s[:, 0], s[:, 2])) & (np.minimum(s[:, 1], s[:, 3]) <= y) & (y <= np.maximum(s[:, 1], s[:, 3]))
    at = np.flatnonzero(out)
    out[at] = orient(*s[at].T, x[at], y[at]) == 0
    return out


def sides(polygons: list[list[np.ndarray]]) -> np.ndarray:
    """(n, 4): both ends of every side of all rings; those without length are left out."""
    s = [np.hstack([r[:-1], r[1:]]) for p in polygons for r in p]
    s = np.concatenate(s) if s else np.zeros((0, 4))
    return s[(s[:, :2] != s[:, 2:]).any(1)]


def locate(polygons: list[list[np.ndarray]], xy: np.ndarray) -> np.ndarray:
    """1 for points inside by the even-odd rule, 0 on the boundary, -1 outside."""
    s, out = sides(polygons), np.full(len(xy), -1, np.int8)
    step = max(1, (1 << 20) // max(1, len(s)))
    for i in range(0, len(xy), step):
        p = xy[i : i + step]
        k, j = np.nonzero((s[None, :, 1] > p[:, 1, None]) != (s[None, :, 3] > p[:, 1, None]))
        odd = np.bincount(k, weights=beyond(s[j], p[k, 0], p[k, 1]), minlength=len(p)) % 2 == 1
        box = (np.minimum(s[:, 0], s[:, 2]) <= p[:, 0, None]) & (np.maximum(s[:, 0], s[:, 2]) >= p[:, 0, None]) & (np.minimum(s[:, 1], s[:, 3]) <= p[:, 1, None]) & (np.maximum(s[:, 1], s[:, 3]) >= p[:, 1, None])
        k, j = np.nonzero(box)
        out[i : i + step] = np.where(odd, 1, -1)
        out[i + k[touching(s[j], p[k, 0], p[k, 1])]] = 0
    return out


def cell_sides(polygons: list[list[np.ndarray]], size: float) -> list[tuple[int, int, bool, np.ndarray]]:
    """For each grid cell that polygons touch: column, row, whether its lower left corner is inside, and the sides that meet it.

    The corner stands for the point just right of and above it, so it is never on the boundary.
    """
    s = sides(polygons)
    if not len(s):
        return []
    lo, hi = np.minimum(s[:, :2], s[:, 2:]), np.maximum(s[:, :2], s[:, 2:])
    first, last = np.floor(lo / size).astype(np.int64), np.floor(hi / size).astype(np.int64)
    (c0, r0), (c1, r1) = first.min(0), last.max(0)
    # sides by the rows of cells that they pass, then by the columns that they meet in each
    i = np.repeat(np.arange(len(s)), last[:, 1] - first[:, 1] + 1)
    row = np.arange(len(i)) - np.repeat(np.cumsum(last[:, 1] - first[:, 1] + 1) - (last[:, 1] - first[:, 1] + 1), last[:, 1] - first[:, 1] + 1) + first[i, 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = (s[i, 2] - s[i, 0]) / (s[i, 3] - s[i, 1])
        ends = [s[i, 0] + (np.clip(y * size, lo[i, 1], hi[i, 1]) - s[i, 1]) * slope for y in (row, row + 1)]
    level = s[i, 1] == s[i, 3]
    slack = 1e-9 * (np.abs(s[i]).max(1) + size)
    left = np.where(level, lo[i, 0], np.maximum(lo[i, 0], np.minimum(*ends) - slack))
    right = np.where(level, hi[i, 0], np.minimum(hi[i, 0], np.maximum(*ends) + slack))
    a, b = np.floor(left / size).astype(np.int64), np.floor(right / size).astype(np.int64)
    many = b - a + 1
    j = np.repeat(np.arange(len(i)), many)
    col = a[j] + np.arange(len(j)) - np.repeat(np.cumsum(many) - many, many)
    # parity of corners: a side that passes the height of a row of corners turns all corners to its left
    turns = np.zeros((r1 - r0 + 1, c1 - c0 + 2), np.int64)
    y = row * size
    m = (s[i, 1] > y) != (s[i, 3] > y)
    k, r, y = i[m], row[m], y[m]
    if len(k):
        x = s[k, 0] + (y - s[k, 1]) * (s[k, 2] - s[k, 0]) / (s[k, 3] - s[k, 1])
        n = np.ceil(x / size).astype(np.int64) + 1  # corners up to n - 1 may lie to the left
        for _ in range(4):  # rounding moves the guess by one at most
            n -= ~beyond(s[k], (n - 1) * size, y)
        np.add.at(turns, (r - r0, np.clip(n - c0, 0, c1 - c0 + 1)), 1)
    inside = np.cumsum(turns[:, ::-1], axis=1)[:, ::-1][:, 1:] % 2 == 1
    cell = (row[j] - r0) * (c1 - c0 + 1) + col - c0
    order = np.argsort(cell, kind="stable")
    cell, own = cell[order], i[j[order]]
    out, met = [], np.zeros(inside.size, bool)
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    for b0, b1 in zip(starts, [*starts[1:], len(cell)], strict=True):
        r, c = divmod(int(cell[b0]), c1 - c0 + 1)
        met[cell[b0]] = True
        out.append((c + c0, r + r0, bool(inside[r, c]), s[own[b0:b1]]))
    for at in np.flatnonzero(inside.ravel() & ~met):
        r, c = divmod(int(at), c1 - c0 + 1)
        out.append((c + c0, r + r0, True, np.zeros((0, 4))))
    return [(int(c), int(r), f, x) for c, r, f, x in out]


def in_cells(x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray, corner: np.ndarray, s: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inside and on the boundary, for points (x, y), each in the cell with corner (cx, cy).

    s (n, 4), of: the sides of all these cells, and the point to which each belongs. From
    the corner, whose state is known, a path goes up and then right to the point; each
    side that it passes turns the state. The path stays in the cell.
    """
    turned = np.zeros(len(x), np.int64)
    m = np.flatnonzero((s[:, 0] > cx[of]) != (s[:, 2] > cx[of]))
    k = of[m]
    np.add.at(turned, k, above(s[m], cx[k], cy[k]) != above(s[m], cx[k], y[k]))
    m = np.flatnonzero((s[:, 1] > y[of]) != (s[:, 3] > y[of]))
    k = of[m]
    np.add.at(turned, k, beyond(s[m], cx[k], y[k]) != beyond(s[m], x[k], y[k]))
    edge = np.zeros(len(x), bool)
    edge[of[touching(s, x[of], y[of])]] = True
    return corner ^ (turned % 2 == 1), edge


def halves(rings: list[np.ndarray], axis: int, at: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rings cut at a line: their parts below and above it (areas by the even-odd rule stay right)."""
    out: tuple[list, list] = ([], [])
    for r in rings:
        d = r[:, axis] - at
        for sign, kept in zip((1, -1), out, strict=True):
            if (sign * d <= 0).all():
                kept.append(r)
                continue
            v, e, f = r[:-1], sign * d[:-1], sign * d[1:]
            cross = e * f < 0
            share = np.where(cross, e / np.where(cross, e - f, 1), 0)[:, None]
            cut = v + share * (r[1:] - v)
            cut[:, axis] = at
            p = np.stack([v, cut], 1).reshape(-1, 2)[np.stack([e <= 0, cross], 1).ravel()]
            if len(p) > 2 and np.ptp(p[:, axis]) > 0:
                kept.append(np.vstack([p, p[:1]]))
    return out


def cell_pieces(polygons: list[list[np.ndarray]], size: float) -> list[tuple[int, int, list[np.ndarray]]]:
    """Column, row and rings of the part in each grid cell, by halving until one cell is left."""
    rings = [r for p in polygons for r in p]
    if not rings:
        return []
    out, todo = [], [rings]
    while todo:
        part = todo.pop()
        xy = np.concatenate(part)
        lo = np.floor(xy.min(0) / size).astype(np.int64)
        hi = np.maximum(np.ceil(xy.max(0) / size).astype(np.int64) - 1, lo)
        if (lo == hi).all():
            out.append((int(lo[0]), int(lo[1]), part))
            continue
        axis = int((hi - lo).argmax())
        todo += [h for h in halves(part, axis, float((lo[axis] + hi[axis] + 1) // 2 * size)) if h]
    return out
