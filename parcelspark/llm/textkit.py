"""Vectorised text primitives over Arrow string columns.

Hashes of byte ranges come from one prefix sum: sum of T[byte] * r**i modulo
2**64, so every range costs one subtraction and one multiplication.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(20240607)
#: Two independent families: a table of byte values and a base each.
_TABLES = _RNG.integers(1, 2**63, (2, 256), dtype=U) * U(2) + U(1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: ASCII white space, as in [\x20\x09-\x0D]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words made of letters: ASCII letters and every byte of a multi-byte character.
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and their offsets; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def groups(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each, or one longer row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


def _powers(n: int, family: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the family's base and of its inverse."""
    if family not in _POWERS or len(_POWERS[family][0]) < n:
        both = []
        for base in (_BASES[family], pow(_BASES[family], -1, 2**64)):
            p = np.full(n, base, U)
            p[0] = 1
            both.append(np.cumprod(p, dtype=U))
        _POWERS[family] = (both[0], both[1])
    up, down = _POWERS[family]
    return up[:n], down[:n]


class RangeHash:
    """64-bit hashes of any byte ranges of a buffer, by one of two independent families."""

    def __init__(self, buf: np.ndarray, family: int = 0):
        up, self._down = _powers(len(buf) + 1, family)
        self._sum = np.zeros(len(buf) + 1, U)
        np.cumsum(_TABLES[family][buf] * up[:-1], dtype=U, out=self._sum[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._down[start])

    def all(self, width: int) -> np.ndarray:
        """Hashes of the ranges of one width, from each place on."""
        h = self._sum[width:] - self._sum[:-width]
        return mix(h * self._down[: len(h)])


def words(buf: np.ndarray, off: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes with letter[byte]; runs end with their row."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    w = letter[buf]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(buf))]
    first[inner] = w[inner]
    last[inner - 1] = w[inner - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


def word_hashes(buf: np.ndarray, off: np.ndarray, letter: np.ndarray, limit: int = 2 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and byte length of each word; long inputs go in blocks cut between words, so memory stays bounded."""
    out_h, out_r, out_n = [], [], []
    a, n = 0, len(buf)
    while a < n:
        b = min(a + limit, n)
        while b < n and b - a < 64 * limit and letter[buf[b - 1]] and letter[buf[b]]:
            gap = np.flatnonzero(~letter[buf[b : b + 65536]])
            b = b + int(gap[0]) if len(gap) else min(b + 65536, n)
        lo = int(np.searchsorted(off, a, "right")) - 1
        hi = int(np.searchsorted(off, b, "left"))
        cut = np.clip(off[lo : hi + 1], a, b) - a
        part = buf[a:b]
        s, e, r = words(part, cut, letter)
        out_h.append(RangeHash(part)(s, e))
        out_r.append(r + lo)
        out_n.append(e - s)
        a = b
    if not out_h:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_h), np.concatenate(out_r), np.concatenate(out_n)


def shingle_hashes(h: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of k words; a row with 1 to k-1 words has one shingle of all of them."""
    counts = np.bincount(row, minlength=n_rows)
    starts = np.concatenate([[0], np.cumsum(counts)])
    out = mix(h)
    acc = out.copy()
    for j in range(1, min(k, len(acc))):
        acc[: len(acc) - j] = acc[: len(acc) - j] * U(0x9E3779B97F4A7C15) + out[j:]
    pos = np.arange(len(h)) - starts[row]
    full = pos + k <= counts[row]
    sh, r = mix(acc[full]), row[full]
    some = [(sh, r)]
    for c in range(1, k):
        short = np.flatnonzero(counts == c)
        x = out[starts[short]]
        for j in range(1, c):
            x = x * U(0x9E3779B97F4A7C15) + out[starts[short] + j]
        some.append((mix(x ^ U(c)), short))
    if sum(len(x) for _, x in some) > len(r):
        sh, r = np.concatenate([x for x, _ in some]), np.concatenate([x for _, x in some])
        order = np.argsort(r, kind="stable")
        sh, r = sh[order], r[order]
    return sh, r
