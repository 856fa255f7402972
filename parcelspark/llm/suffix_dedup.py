"""Removal of every byte of a 100-byte string that also starts earlier, with a sparse suffix array.

A 100-byte window is represented by the suffix at its anchor: the position of
the smallest hash among the window's 32-byte strings. Equal windows have equal
anchors, and consecutive windows mostly share one, so about one suffix in 35 is
kept. A unit is the run of windows with one anchor; its content reaches from its
first window's start to its last window's end.

1. Units are range-partitioned by sampled splitters on the leading bytes of
   their suffix, then hashes of its 32 bytes and of the whole unit, then place.
   The place is part of the key, so a unit that occurs everywhere is split over
   buckets. Buckets are sorted locally by multikey quicksort. A unit equal to the
   one before it is a repeat: all its windows start earlier elsewhere. Of first units
   whose 32 bytes also occur in a different unit, those windows are candidates that
   hold half of the rest before the anchor (after it), if those bytes with the 32 also
   occur in a different one; a window has one half or the other. The first units of the
   groups at a bucket's two ends, whose neighbours are unknown, are candidates whole.
2. Windows of candidates only are partitioned and sorted in the same way, each by
   its leading bytes, its hashes and its place. A window equal to the one before it
   is a repeat; the first window of a bucket is compared across the boundary with
   the last ones of the buckets before, by a join on their hashes.
3. Repeated windows are merged per document, and the texts cut.

Every position of every text is covered: no window is sampled away. Equality is by
8 leading bytes and 96 bits of hashes (units), or 4 leading bytes and 80 bits of hashes
(windows), so that 10**11 windows with the same leading bytes hold a false pair with
a chance of about 0.004.

Defined cases: null text is empty; texts under 100 bytes lose nothing; rows equal in
identifier and text are one document (equal places in it are no repeats of each
other, and what is removed is removed from each); different texts under one
identifier are documents of their own, in an order by a hash of the text; null
identifiers come before all others; an empty table gives an empty result. Other
input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm import textkit as K
from parcelspark.llm.rowkeys import keyed, side
from parcelspark.scratch import drop, prepare, stash

#: Positions that fit into the low bits of an anchor's sort key.
_POS_BITS = K.U(23)
NONE = -(2**63)
#: A document is its identifier and a tag, 0 but for null and repeated identifiers.
#: at: from a unit's first window to its anchor; sides: 16 bits of the hashes of each side with the gram.
UNIT = "kind int, lead long, gram int, unit long, doc long, tag long, lo long, hi long, at int, sides int"
RUN = "kind int, doc long, tag long, lo long, hi long"
WINDOW = "lead int, hash long, more short, doc long, tag long, lo long"
EDGE = "kind int, doc long, tag long, lo long, hi long, part int, lead int, hash long, more short"


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by block prefix and suffix minima."""
    n = len(x) - w + 1
    pad = np.full(-len(x) % w, np.iinfo(x.dtype).max, x.dtype)
    rows = np.concatenate([x, pad]).reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def leading(buf: np.ndarray, at: np.ndarray, size: int = 8) -> np.ndarray:
    """The 8 or 4 bytes from each position as signed integers in byte order."""
    kind, signed = (K.U, np.int64) if size == 8 else (np.uint32, np.int32)
    out = np.zeros(len(at), kind)
    for j in range(size):
        out = (out << kind(8)) | buf[at + j].astype(kind)
    return (out ^ kind(1 << (8 * size - 1))).view(signed)


def units(buf: np.ndarray, off: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, first and last window start, leading bytes, gram hash, content hash, anchor and hashes of its sides of each unit, in text order."""
    n = len(buf) - width + 1
    z, z4 = np.zeros(0, np.int64), np.zeros(0, np.int32)
    if n < 1:
        return z, z, z, z, z4, z, z4, z4
    rh = K.RangeHash(buf)
    g = rh.all(gram)
    low = (K.U(1) << _POS_BITS) - K.U(1)
    key = (g & ~low) | np.arange(len(g), dtype=K.U)
    anchor = (sliding_min(key, width - gram + 1)[:n] & low).astype(np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[:n]
    p = np.flatnonzero(np.arange(n) + width <= off[1:][row])
    if not len(p):
        return z, z, z, z, z4, z, z4, z4
    a = anchor[p]
    first = np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)])
    lo = p[first]
    hi = p[np.concatenate([np.flatnonzero(first)[1:] - 1, [len(p) - 1]])]
    a, r = a[first], row[lo]
    whole = rh(lo, hi + width).view(np.int64)
    # windows that begin up to here hold the left side; those after it one byte more than the rest on the right
    left = half(width, gram)
    sides = rh(np.maximum(a - left, 0), a + gram) >> K.U(48) << K.U(16) | rh(a, np.minimum(a + width - left + 1, len(buf))) >> K.U(48)
    return r, lo - off[r], hi - off[r], leading(buf, a), (g[a] >> K.U(32)).astype(np.uint32).view(np.int32), whole, (a - lo).astype(np.int32), sides.astype(np.uint32).view(np.int32)


def half(width: int, gram: int) -> int:
    """Bytes before its anchor from which on a window is told by its left side."""
    return (width - gram) // 2


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Order by several words: quicksort on the first, and on each next word within the runs that are still equal."""
    order = np.argsort(keys[0], kind="quicksort")
    for depth in range(1, len(keys)):
        tied = np.ones(len(order), bool)
        for k in keys[:depth]:
            s = k[order]
            tied[1:] &= s[1:] == s[:-1]
        tied[:1] = False
        inner = tied.copy()
        inner[:-1] |= tied[1:]
        at = np.flatnonzero(inner)
        if not len(at):
            break
        run = np.cumsum(~tied)[at]
        order[at] = order[at][np.lexsort((keys[depth][order[at]], run))]
    return order


def _blocks(buf: np.ndarray, off: np.ndarray, width: int, block: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """First row, bytes, offsets and first position: whole rows together, or blocks of one long row that overlap by a window."""
    for i, j in K.groups(off, block):
        n = int(off[j] - off[i])
        if n <= block:
            yield i, buf[off[i] : off[j]], off[i : j + 1] - off[i], 0
        else:
            for s in range(0, n - width + 1, block):
                part = buf[off[i] + s : off[i] + min(s + block + width - 1, n)]
                yield i, part, np.array([0, len(part)]), s


def _merge(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins ranges that touch; rows sorted by (row, lo)."""
    cut = np.concatenate([[True], (row[1:] != row[:-1]) | (lo[1:] > hi[:-1] + 1)]) if len(row) else np.zeros(0, bool)
    at = np.flatnonzero(cut)
    return row[at], lo[at], np.maximum.reduceat(hi, at) if len(at) else hi


def _map_units(width: int, gram: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, tag = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, part, cut, base in _blocks(*K.flat(b.column(2)), width, block):
                r, lo, hi, lead, g, whole, at, sides = units(part, cut, width, gram)
                if not len(r):
                    continue
                # repeats inside one document, as in periodic text, are known at once
                o = multikey_order([whole, lead, g.astype(np.int64), r, lo])
                again = np.zeros(len(r), bool)
                same = np.ones(len(r) - 1, bool)
                for k in (whole, lead, g, r):
                    same &= k[o][1:] == k[o][:-1]
                again[o[1:][same]] = True
                k = ~again
                yield _batch(UNIT, np.zeros(k.sum(), np.int32), lead[k], g[k], whole[k], doc[i + r[k]], tag[i + r[k]], lo[k] + base, hi[k] + base, at[k], sides[k])
                if again.any():
                    rr, a, z = _merge(r[again], lo[again], hi[again])
                    n = np.zeros(len(rr), np.int64)
                    n4 = n.astype(np.int32)
                    yield _batch(UNIT, n4 + 1, n, n4, n, doc[i + rr], tag[i + rr], a + base, z + base, n4, n4)

    return run


def _batch(schema: str, *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [x.split()[0] for x in schema.split(", ")])


def _bucket(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return None
    t = pa.Table.from_batches(parts)
    return [c.to_numpy() for c in t.columns]


def _repeats(keys: list[np.ndarray], place: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """In sorted order: where a new key begins, and which rows repeat an earlier place."""
    new = np.ones(len(keys[0]), bool)
    for i, k in enumerate(keys):
        new[1:] = (k[1:] != k[:-1]) | (new[1:] if i else False)
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    again = np.zeros(len(new), bool)
    for x in place:
        again |= x != x[first]
    return new, again


def _candidates(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, sides: np.ndarray, left: int) -> tuple[np.ndarray, np.ndarray]:
    """Range of the windows of each unit that may occur in another one of its group, by the sides of their anchor; empty where hi < lo."""
    mid = lo + at - left
    some = []
    for has, side in ((at >= left, sides >> 16), (hi > mid, sides & 0xFFFF)):
        key = group << 16 | side.astype(np.int64) & 0xFFFF
        _, back, n = np.unique(key[has], return_inverse=True, return_counts=True)
        several = np.zeros(len(key), bool)
        several[has] = n[back] > 1
        some.append(several)
    return np.where(some[0], lo, np.maximum(lo, mid + 1)), np.where(some[1], hi, np.minimum(hi, mid))


def _sort_units(left: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = _bucket(batches)
        if cols is None:
            return
        o = multikey_order(cols[:6])
        lead, gram, unit, doc, tag, lo, hi, at, sides = (c[o] for c in cols)
        new, again = _repeats([lead, gram, unit], [doc, tag, lo])
        group = np.cumsum(np.concatenate([[True], (lead[1:] != lead[:-1]) | (gram[1:] != gram[:-1])])) - 1
        several = np.bincount(group, weights=new) > 1
        several[[0, -1]] = True
        w = np.flatnonzero(~again & several[group])
        a, z = _candidates(group[w], lo[w], hi[w], at[w], sides[w], left)
        ends = (group[w] == 0) | (group[w] == group[-1])
        a, z = np.where(ends, lo[w], a), np.where(ends, hi[w], z)
        w, a, z = w[a <= z], a[a <= z], z[a <= z]
        for kind, m, first, last in ((1, again, lo[again], hi[again]), (2, w, a, z)):
            if len(first):
                yield _batch(RUN, np.full(len(first), kind, np.int32), doc[m], tag[m], first, last)

    return run


def _sort_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    cols = _bucket(batches)
    if cols is None:
        return
    o = multikey_order(cols)
    keys, (doc, tag, lo) = [c[o] for c in cols[:3]], (c[o] for c in cols[3:])
    _, again = _repeats(keys, [doc, tag, lo])
    at = np.flatnonzero(again)
    at = at[np.lexsort((lo[at], tag[at], doc[at]))]
    row = np.cumsum(np.concatenate([[False], (doc[at][1:] != doc[at][:-1]) | (tag[at][1:] != tag[at][:-1])])) if len(at) else at
    r, a, z = _merge(row, lo[at], lo[at])
    start = at[np.searchsorted(row, r)]
    n, part = np.zeros(len(r), np.int64), TaskContext.get().partitionId()
    yield _batch(EDGE, np.ones(len(r), np.int32), doc[start], tag[start], a, z, *(x.astype(t) for x, t in ((n, np.int32), (n, np.int32), (n, np.int64), (n, np.int16))))
    # the rows of the first key may repeat a key at the end of a bucket before
    ends = np.array([0, len(doc) - 1])
    yield _batch(EDGE, np.array([3, 4], np.int32), doc[ends], tag[ends], lo[ends], lo[ends], np.full(2, part, np.int32), *(k[ends] for k in keys))


def _map_windows(width: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, tag = b.column(0).to_numpy(), b.column(1).to_numpy()
            buf, off = K.flat(b.column(2))
            spans = b.column(3)
            at = np.frombuffer(spans.buffers()[1], np.int32)[spans.offset : spans.offset + len(spans) + 1]
            values = spans.values
            row = np.repeat(np.arange(b.num_rows), np.diff(at))
            lo, hi = (values.field(j).to_numpy()[at[0] : at[-1]] for j in (0, 1))
            hi = np.minimum(hi, np.diff(off)[row] - width)
            o = np.lexsort((lo, row))
            o = o[lo[o] <= hi[o]]
            row, lo, hi = _merge(row[o], lo[o], hi[o])
            # ranges of at most a block of windows, then as many of them as have a block of bytes
            times = -(-(hi + 1 - lo) // block)
            step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row, lo, hi = (np.repeat(x, times) for x in (row, lo, hi))
            lo = lo + step * block
            n = np.minimum(hi + 1 - lo, block)
            for i, j in K.groups(np.concatenate([[0], np.cumsum(n + width - 1)]), block):
                r, s, m = row[i:j], lo[i:j], n[i:j]
                # the bytes of the ranges end to end, and the places there where windows start
                size = m + width - 1
                base = np.cumsum(size) - size
                part = buf[np.arange(size.sum()) + np.repeat(off[r] + s - base, size)]
                p = np.arange(m.sum()) + np.repeat(base - np.cumsum(m) + m, m)
                more = (K.RangeHash(part, 1)(p, p + width) >> K.U(48)).astype(np.uint16).view(np.int16)
                yield _batch(WINDOW, leading(part, p, 4), K.RangeHash(part)(p, p + width).view(np.int64), more, np.repeat(doc[r], m), np.repeat(tag[r], m), p + np.repeat(s - base, m))

    return run


def _map_cut(width: int):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = K.flat(b.column(1))
            out = []
            for i, spans in enumerate(b.column(2)):
                text = buf[off[i] : off[i + 1]]
                values = spans.values
                if values is None or not len(values):
                    out.append((len(text), 0, 0, hashlib.sha256(text.tobytes()).hexdigest()))
                    continue
                lo, hi = values.field(0).to_numpy(), values.field(1).to_numpy() + width
                o = np.argsort(lo, kind="stable")
                lo, hi = lo[o], np.minimum(np.maximum.accumulate(hi[o]), len(text))
                lo, hi = lo[lo < hi], hi[lo < hi]
                cut = np.concatenate([[True], lo[1:] > hi[:-1]]) if len(lo) else np.zeros(0, bool)
                s = lo[cut]
                e = hi[np.concatenate([np.flatnonzero(cut)[1:] - 1, [len(lo) - 1]])] if len(lo) else hi
                digest, last = hashlib.sha256(), 0
                for x, y in zip(s, e, strict=True):
                    digest.update(text[last:x].tobytes())
                    last = y
                digest.update(text[last:].tobytes())
                out.append((len(text), int((e - s).sum()), len(s), digest.hexdigest()))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names)

    return run


def repeated_windows(rows: DataFrame, width: int, gram: int, bucket_rows: int, block: int) -> DataFrame:
    """(doc, tag, lo, hi): ranges of window starts that also start earlier. rows: doc, tag, text."""
    spark = rows.sparkSession
    parts = lambda t: max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-t.count() // bucket_rows))
    found = stash(rows.mapInArrow(_map_units(width, gram, block), UNIT), "suffix-units")
    heads = found.where("kind = 0").drop("kind")
    ranged = heads.repartitionByRange(parts(heads), "lead", "gram", "unit", "doc", "tag", "lo")
    inner = found.where("kind = 1").select(*[x.split()[0] for x in RUN.split(", ")])
    runs = stash(ranged.mapInArrow(_sort_units(half(width, gram)), RUN).unionByName(inner), "suffix-runs")
    drop(found)
    wanted = _per_document(runs.where("kind = 2"))
    windows = stash(rows.join(wanted, ["doc", "tag"]).select("doc", "tag", "text", "spans").mapInArrow(_map_windows(width, block), WINDOW), "suffix-windows")
    ranged = windows.repartitionByRange(parts(windows), "lead", "hash", "more", "doc", "tag", "lo")
    edges = stash(ranged.mapInArrow(_sort_windows, EDGE), "suffix-edges")
    drop(windows)
    # one row per bucket and end: a bucket's first window repeats an equal one at the end of a bucket before
    key, place = ["lead", "hash", "more"], ["doc", "tag", "lo"]
    last = edges.where("kind = 4").groupBy(*key).agg(F.min(F.struct("part", *place)).alias("before"))
    first = edges.where("kind = 3").join(last, key).where("before.part < part AND (before.doc, before.tag, before.lo) <> (doc, tag, lo)")
    span = ["doc", "tag", "lo", "hi"]
    return runs.where("kind = 1").select(span).unionByName(edges.where("kind = 1").select(span)).unionByName(first.select(span))


def _per_document(spans: DataFrame) -> DataFrame:
    """doc, tag, spans; broadcast where they are few, by their count."""
    return side(spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), 8 * spans.count())


def suffix_dedup(docs: DataFrame, width: int = 100, gram: int = 32, bucket_rows: int = 600_000, id_col: str = "doc_id", text_col: str = "text", block: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every whole text. block: bytes of a long text at a time."""
    if not 8 <= gram <= width:
        raise ValueError("gram must hold the 8 leading bytes and fit into the width")
    prepare(docs.sparkSession)
    own = keyed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    doc = F.coalesce("doc_id", F.lit(NONE))
    rows = own.select(doc.alias("doc"), F.when(F.col("key") == doc, F.lit(0)).otherwise(F.col("key")).cast("long").alias("tag"), F.coalesce("text", F.lit("")).alias("text"))
    spans = stash(repeated_windows(rows, width, gram, bucket_rows, block), "suffix-spans")
    kind = "array<struct<lo:long,hi:long>>"
    out = rows.join(_per_document(spans), ["doc", "tag"], "left").select(F.when(F.col("doc") != F.lit(NONE), F.col("doc")).alias("doc_id"), "text", F.coalesce("spans", F.array().cast(kind)).alias("spans"))
    return out.mapInArrow(_map_cut(width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
