"""SimHash fingerprints and block tables for a Hamming radius.

Terms are word pairs (words between ASCII white space); each occurrence votes on
every bit with the byte length of its words as weight, so long words, which are
rarer, count more. Fingerprints have 128 bits, written as 32 hexadecimal digits.

The edited text of a document needs the next document by identifier. Documents
go to buckets of consecutive identifiers (one exchange of the texts); the first
document of each bucket also goes to the bucket before it, so no global order is
ever sorted in one task. Rows of an identifier, or without one, that would fill a bucket
alone are cut by the hash of their texts; only rows equal in both stay together.

Defined cases: null text counts as empty; an empty text has no terms and the
fingerprint 0; a text of one word has that word as its term; equal identifiers
follow each other by the hash of their texts; null identifiers come first; an
empty table gives an empty result. Other input columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.llm import textkit as K
from parcelspark.scratch import drop, prepare, stash

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
BITS = 128
#: The smallest 64-bit integer, from which hashes begin.
LEAST = -(1 << 63)
#: Rows of one leading part of a block aimed at; the leading bits, and with them the tasks, grow with the table.
SLOT_ROWS = 1 << 10
#: Over nine in ten pairs of documents with a 5-gram Jaccard similarity of 0.8 differ by no more bits.
RADIUS = 18


def fingerprints(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(rows, 2) unsigned 64-bit halves."""
    n = len(off) - 1
    out = np.zeros((n, 2), K.U)
    for i, j in K.groups(off, 1 << 20):
        h, r, size = K.word_hashes(buf[off[i] : off[j]], off[i : j + 1] - off[i], ~K.SPACE)
        if not len(h):
            continue
        counts = np.bincount(r, minlength=j - i)
        pair = np.zeros(len(h), bool)
        pair[:-1] = r[1:] == r[:-1]
        keep = pair | (counts[r] == 1)
        nxt = np.minimum(np.arange(len(h)) + 1, len(h) - 1)
        term = np.where(pair, K.mix(h) * K.U(0x9E3779B97F4A7C15) + h[nxt], h)[keep]
        weight = np.where(pair, size + size[nxt], size)[keep].astype(np.float64)
        r = r[keep]
        votes = np.zeros((j - i, BITS), np.float64)
        for a in range(0, len(term), 32768):
            t, w, rr = term[a : a + 32768], weight[a : a + 32768], r[a : a + 32768]
            both = np.stack([K.mix(t), K.mix(t ^ K.U(0xA5A5A5A55A5A5A5A))], 1)
            signs = np.unpackbits(both.view(np.uint8).reshape(len(t), 16), axis=1).astype(np.float64)
            signs -= 0.5
            signs *= w[:, None]
            starts = np.flatnonzero(np.concatenate([[True], rr[1:] != rr[:-1]]))
            votes[rr[starts]] += np.add.reduceat(signs, starts, axis=0)
        out[i:j] = np.packbits(votes > 0, axis=1).reshape(-1, 16).view(K.U)
    return out


def hexes(fp: np.ndarray) -> list[str]:
    raw = fp.tobytes().hex()
    return [raw[i : i + 32] for i in range(0, len(raw), 32)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.bitwise_count(a ^ b).sum(1) / BITS


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every whole text."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hexes(fingerprints(*K.flat(b.column(1)))), pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text (see SCHEMA)."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = sorted({int(x) for x in ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n)}) if n > 1 else []
    # an identifier, or none, that would fill a bucket alone is cut by the hash of its texts; at most n rows
    counts = stash(ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 OR doc_id IS NULL"), "identifiers")
    room = max(2, -(-ids.count() // n))
    hot = {r["doc_id"]: -(-r["c"] // room) for r in counts.where(F.col("c") > room).collect()} if n > 1 else {}
    drop(counts)
    keys = sorted({(1, m, LEAST) for m in marks} | {(int(d is not None), d or 0, LEAST + (i << 64) // k) for d, k in hot.items() for i in range(1, k)})
    order = F.xxhash64("text") if hot else F.lit(LEAST)
    rows = rows.withColumn("order", order)
    bucket = _bucket(F.col("doc_id"), F.col("order"), keys)
    # one row per bucket: as many as there are keys reach the driver
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "order"))
    firsts = sorted(((r["b"], r["m"]) for r in rows.groupBy(bucket.alias("b")).agg(least.alias("m")).collect()), key=lambda x: x[0])
    if not firsts:
        return spark.createDataFrame([], SCHEMA)
    before = [(m["doc_id"] if m["some"] else None, m["order"], firsts[i - 1][0], int(i == 0)) for i, (_, m) in enumerate(firsts)]
    halo = spark.createDataFrame(before, "m long, o long, to int, wrap int")
    # bounded: one row per bucket
    there = rows.join(F.broadcast(halo), F.expr("doc_id <=> m AND order = o"), "left")
    own = F.struct(bucket.alias("b"), F.lit(0).alias("halo"))
    dealt = there.select("doc_id", "text", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("to").alias("b"), (F.col("wrap") + 1).alias("halo"))))).alias("x"))
    dealt = dealt.select("doc_id", "text", "x.b", "x.halo").repartitionById(max(x[0] for x in firsts) + 1, "b")
    ordered = dealt.sortWithinPartitions("b", "halo", "doc_id", F.xxhash64("text")).select("doc_id", "text", "halo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, done = 0, False
        for b in batches:
            for doc_id, text, halo in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if done:
                    continue
                held.append((doc_id, text))
                size += len(text)
                done = halo > 0  # the first document after this bucket
                if size > 1 << 20 and len(held) > 1 and not done:
                    yield _likeness_rows(held)
                    held, size = held[-1:], len(held[-1][1])
        if len(held) > 1:
            yield _likeness_rows(held)

    return ordered.mapInArrow(run, SCHEMA)


def _bucket(doc_id: Column, order: Column, keys: list[tuple[int, int, int]]) -> Column:
    """How many keys (whether there is an identifier, the identifier, a hash) are at most a row's, by binary search over literal arrays."""
    if not keys:
        return F.lit(0)
    known = [F.split(F.lit(",".join(map(str, c))), ",").cast("array<bigint>") for c in zip(*keys, strict=True)]  # each folds into one literal
    mine = [doc_id.isNotNull().cast("long"), F.coalesce(doc_id, F.lit(0)), order]
    return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(len(keys).bit_length())), F.struct(F.lit(0).alias("lo"), F.lit(len(keys)).alias("hi")), lambda s, _: _halve(s, mine, known), lambda s: s["lo"]), F.lit(0))


def _halve(s: Column, mine: list[Column], known: list[Column]) -> Column:
    mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    a, b, c = (F.get(k, mid) for k in known)
    reached = (a < mine[0]) | ((a == mine[0]) & ((b < mine[1]) | ((b == mine[1]) & (c <= mine[2]))))
    right = F.coalesce(reached, F.lit(False)) & (s["lo"] < s["hi"])
    return F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))


def _likeness_rows(held: list[tuple]) -> pa.RecordBatch:
    """Rows of all but the last document, which is only the next of the one before it."""
    texts = [t for _, t in held]
    edited = []
    for t, following in zip(texts, texts[1:], strict=False):
        k = len(t) // 4
        edited.append(t[: len(t) - k] + following[:k])
    fp = fingerprints(*K.flat(pa.array(texts, pa.large_string())))
    fe = fingerprints(*K.flat(pa.array(edited, pa.large_string())))
    cols = [
        pa.array([d for d, _ in held[:-1]], pa.int64()),
        pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        pa.array(hexes(fp[:-1])),
        pa.array(hexes(fe)),
        pa.array(likeness(fp[:-1], fe)),
        pa.array(likeness(fp[:-1], fp[1:])),
    ]
    return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SCHEMA.split(", ")])


def with_neighbours(rows: DataFrame, radius: int = RADIUS, every: int = 50) -> DataFrame:
    """rows with n_near: for identifiers divisible by `every` the number of other documents within the radius, else null.

    Equal fingerprints are one row with a count, so a group of copies costs one row per task.
    """
    rows = stash(rows, "fingerprints")
    lead = min(16, max(8, math.ceil(math.log2(max(1, rows.count()) / SLOT_ROWS))))
    near = near_counts(rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.col("doc_id") % every == 0), F.lit(False)).alias("asked")), radius, lead=lead)
    # one fingerprint may hold a third of all rows; narrow rows, split by adaptive execution
    out = rows.join(near.select("fingerprint", (F.col("near") - 1).alias("n_near")), "fingerprint", "left")
    return out.select(*rows.columns, F.when(F.col("doc_id") % every == 0, F.col("n_near")).alias("n_near"))


def near_counts(table: DataFrame, radius: int = RADIUS, blocks: int = 6, lead: int = 8) -> DataFrame:
    """(fingerprint, near) for the asked rows of a table (fingerprint, n, asked) of distinct fingerprints: the sum of n within the radius.

    Bits are cut into an even number of blocks, and the radius into shares with
    sum(share + 1) = radius + 1; two fingerprints within the radius differ by no more
    than its share in one block at least, so every pair is found. A row goes to the
    leading bits of each of its blocks, an asked row also to all leading bits that its
    share reaches; there the rest of its block is probed at the distance that is left. A
    pair counts in the first block that holds it. No pair becomes a row.
    """
    prepare(table.sparkSession)
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    shares = [(radius + 1 + i) // blocks - 1 for i in range(blocks)]
    cut = [(a // 64, K.U(64 - (b - a // 64 * 64)), K.U((1 << (b - a)) - 1), b - a - lead) for a, b in zip(edges, edges[1:], strict=False)]
    used = [i for i in range(blocks) if shares[i] >= 0]
    reach = lambda width, most: np.array([sum(1 << x for x in c) for k in range(min(most, width) + 1) for c in combinations(range(width), k)], K.U)
    part = lambda fp, i: (fp[:, cut[i][0]] >> cut[i][1]) & cut[i][2]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = np.frombuffer(bytes.fromhex("".join(b.column(0).to_pylist())), ">u8").reshape(-1, 2)
            n, asked = b.column(1).to_numpy(), np.flatnonzero(b.column(2).to_numpy(zero_copy_only=False))
            fp = raw.astype(K.U)
            for i in used:
                head = part(fp, i) >> K.U(cut[i][3])
                there = head[asked, None] ^ reach(lead, shares[i])
                who = np.concatenate([np.repeat(asked, there.shape[1]), np.arange(len(fp))])
                slot = np.concatenate([there.ravel(), head]).astype(np.int64) + (i << lead)
                kind = np.arange(len(who)) >= there.size
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(kind), *(pa.array(fp[who, h].view(np.int64)) for h in (0, 1)), pa.array(n[who])], ["slot", "kept", "a", "b", "n"])

    def count(slot: int, asked: np.ndarray, held: np.ndarray, n: np.ndarray, near: np.ndarray) -> None:
        i = slot >> lead
        rest = K.U((1 << cut[i][3]) - 1)
        order = np.argsort(part(held, i) & rest, kind="stable")
        held, n = held[order], n[order]
        start = np.searchsorted(part(held, i) & rest, np.arange(int(rest) + 2, dtype=K.U))
        own = part(asked, i)
        left = shares[i] - np.bitwise_count((own >> K.U(cut[i][3])) ^ K.U(slot & ((1 << lead) - 1))).astype(np.int64)
        for k in range(shares[i] + 1):
            masks, these = reach(cut[i][3], k), np.flatnonzero(left == k)
            for at in np.array_split(these, -(-len(these) * len(masks) // (1 << 20)) or 1):
                probe = ((own[at, None] & rest) ^ masks).ravel().astype(np.int64)
                size = start[probe + 1] - start[probe]
                hit = np.flatnonzero(size)
                for some in np.split(hit, np.flatnonzero(np.diff(np.cumsum(size[hit]) >> 21)) + 1):
                    m = size[some]
                    q = np.repeat(at[some // len(masks)], m)
                    t = np.repeat(start[probe[some]] - np.cumsum(m) + m, m) + np.arange(m.sum())
                    x = asked[q] ^ held[t]
                    ok = np.bitwise_count(x).sum(1) <= radius
                    q, t, x = q[ok], t[ok], x[ok]
                    for j in used[: used.index(i)]:
                        ok = np.bitwise_count(part(x, j)) > shares[j]
                        q, t, x = q[ok], t[ok], x[ok]
                    np.add.at(near, q, n[t])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, asked, near = -1, np.zeros((0, 2), K.U), np.zeros(0, np.int64)
        waits: list[tuple] = []  # kept rows of the slot, counted in bounded parts

        def flush() -> None:
            if waits and len(asked):
                count(slot, asked, np.concatenate([w[0] for w in waits]), np.concatenate([w[1] for w in waits]), near)
            waits.clear()

        def result() -> pa.RecordBatch:
            some = near > 0
            return pa.RecordBatch.from_arrays([pa.array(hexes(asked[some].astype(">u8")), pa.string()), pa.array(near[some])], ["fingerprint", "near"])

        for b in batches:
            if not b.num_rows:
                continue
            slots, kept, n = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(4).to_numpy()
            fp = np.stack([b.column(2).to_numpy(), b.column(3).to_numpy()], 1).view(K.U)
            for lo, hi in zip(c := np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]])), [*c[1:], len(slots)], strict=True):
                if slots[lo] != slot:
                    flush()
                    yield result()
                    slot, asked, near = int(slots[lo]), np.zeros((0, 2), K.U), np.zeros(0, np.int64)
                mid = lo + int((~kept[lo:hi]).sum())
                if mid > lo:
                    asked, near = np.concatenate([asked, fp[lo:mid]]), np.zeros(len(asked) + mid - lo, np.int64)
                if hi > mid:
                    waits.append((fp[mid:hi], n[mid:hi]))
                if sum(len(w[1]) for w in waits) > 1 << 18:
                    flush()
        flush()
        yield result()

    dealt = table.select("fingerprint", "n", "asked").mapInArrow(deal, "slot long, kept boolean, a long, b long, n long")
    there = dealt.repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), "slot").sortWithinPartitions("slot", "kept")
    return there.mapInArrow(run, "fingerprint string, near long").groupBy("fingerprint").agg(F.sum("near").alias("near"))
