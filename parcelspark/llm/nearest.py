"""Approximate search for largest inner products by score-aware (anisotropic) quantisation.

A sample trains leaves (k-means) and, for what is left of a vector beyond its leaf's
centre, sixteen code words for every two components. Both the choice of codes and
the code words minimise a loss in which the part of the error that is parallel to
the vector weighs more than the rest, since only that part moves the large inner
products. Every vector is encoded, four bits for two components.

A query is compared with the codes of a leaf through tables: its products with the
code words, as bytes, summed by looking up two codes at a time. Whatever comes
within the error of the k-th best sum goes to the exact products of the original
vectors in double precision, however much that is. Leaves are taken in order of the
query's product with their centres, as many as the sample needs to hold `coverage`
of its own true neighbours. Where vectors have no clusters that is most leaves, and
the work then grows with the square of the table.

Equal vectors are one entry with its k + 1 smallest identifiers, as no more of them
can be in a result, and equal queries are one search. Small leaves share a block and
large ones are split into several, queries go to chunks, all of bounded size, and each
pair of block and chunk is a group of its own, so neither a large leaf nor a common
vector meets in one task. A block gives a query its k + 1 best.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite
components, and rows without an identifier take no part; of several lengths only
vectors of the commonest (of equals the shortest) do. Repeated rows count once. An
identifier with several vectors is one candidate, or query, with its largest
products. Fewer candidates than k give fewer rows; an empty table gives none. Other
input columns are ignored. Equal queries share a search by 128 bits of hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelspark.scratch import drop, prepare, stash

SCHEMA = "query_id long, rank int, vec_id long, score double"
#: Vectors that the fit reads at most, and their bytes.
SAMPLE, SAMPLE_BYTES = 16_384, 32 << 20
#: Of those the vectors that the code words are fitted to.
WORDS = 8192
#: Entries of a leaf aimed at, while the sample holds sixteen for each leaf.
LEAF_ROWS = 2048
#: Share of its true neighbours that the sample finds in the leaves of a query.
COVERAGE = 0.97
#: Inner products above this share of the norms are those that the loss protects.
THRESHOLD = 0.2
#: Standard errors of a table's sum within which entries go to the exact products.
ERRORS = 2.5
#: Entries of a block and queries of a chunk, for vectors of up to 2 KB.
BLOCK, CHUNK, BLOCK_BYTES = 32_768, 1024, 16 << 20


@dataclass
class Index:
    """centres (leaves, d) of leaves; words (d / 2, 16, 2) of codes, d padded to a multiple of four; error of a sum for a unit query."""

    centres: np.ndarray
    words: np.ndarray
    weight: float
    error: float
    probes: int

    @property
    def width(self) -> int:
        return 2 * len(self.words)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The nearest centre of each vector."""
        return np.argmin((self.centres**2).sum(1) - 2 * (x @ self.centres.T), axis=1)

    def encode(self, x: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Bytes of two codes each, (rows, d / 4)."""
        codes = np.concatenate([choose(*_parts(x[i : i + 2048], self.centres[leaf[i : i + 2048]], self.width), self.words, self.weight)[0] for i in range(0, len(x), 2048)])
        return (codes[:, 0::2] | codes[:, 1::2] << 4).astype(np.uint8)

    def decode(self, codes: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        both = np.stack([codes & 15, codes >> 4], 2).reshape(len(codes), -1)
        return self.centres[leaf] + self.words[np.arange(len(self.words)), both].reshape(len(codes), -1)[:, : self.centres.shape[1]]

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query sums of bytes for every pair of codes, (rows, d / 4, 256), and what one unit of them is worth."""
        t = np.einsum("qsd,swd->qsw", _split(q, self.width), self.words)
        t -= t.min(2, keepdims=True)
        unit = t.max((1, 2)) / 255
        unit[unit == 0] = 1
        t = np.rint(t / unit[:, None, None]).astype(np.uint16 if len(self.words) <= 256 else np.uint32)
        return (t[:, 1::2, :, None] + t[:, 0::2, None, :]).reshape(len(q), -1, 256), unit


def _split(x: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x
    return out.reshape(len(x), -1, 2)


def _parts(x: np.ndarray, centre: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What is left beyond the centre, and the direction of the vector, both in pairs of components."""
    return _split(x - centre, width), _split(x / np.linalg.norm(x, axis=1, keepdims=True), width)


def choose(rest: np.ndarray, unit: np.ndarray, words: np.ndarray, weight: float, sweeps: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes with a small loss |error|^2 + weight * (error along the vector)^2, by coordinate descent; that loss, and the error along the vector."""
    off = rest[:, :, None, :] - words
    dist, along = (off**2).sum(3), np.einsum("nswd,nsd->nsw", off, unit)
    code, rows = dist.argmin(2), np.arange(len(rest))
    total = np.take_along_axis(along, code[:, :, None], 2).sum((1, 2))
    for _ in range(sweeps if weight else 0):
        for s in range(len(words)):
            others = total - along[rows, s, code[:, s]]
            code[:, s] = (dist[:, s] + weight * (others[:, None] + along[:, s]) ** 2).argmin(1)
            total = others + along[rows, s, code[:, s]]
    loss = np.take_along_axis(dist, code[:, :, None], 2).sum((1, 2)) + weight * total**2
    return code, loss, total


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (centres**2).sum(1) - 2 * (x @ centres.T)
        at = near.argmin(1)
        count = np.bincount(at, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        full = count > 0
        centres[full] = sums[full] / count[full, None]
        if not full.all():  # an empty leaf begins anew at the vectors farthest from theirs
            far = np.argsort(-(near[np.arange(len(x)), at] + (x**2).sum(1)))[: int((~full).sum())]
            centres[~full] = x[far]
    return centres


def _words(rest: np.ndarray, unit: np.ndarray, weight: float, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """Code words that minimise the loss, in turns with the codes."""
    n, m, _ = rest.shape
    words = rest[rng.integers(0, n, 16)].transpose(1, 0, 2).copy() + 1e-9 * rng.standard_normal((m, 16, 2))
    for turn in range(rounds):
        code, total = np.zeros((n, m), np.int64), np.zeros(n)
        for i in range(0, n, 2048):
            code[i : i + 2048], _, total[i : i + 2048] = choose(rest[i : i + 2048], unit[i : i + 2048], words, weight if turn else 0.0)
        w = weight if turn else 0.0
        for s in range(m):
            r, u, c = rest[:, s], unit[:, s], code[:, s]
            others = total - ((r - words[s][c]) * u).sum(1)
            left, right = np.zeros((16, 2, 2)), np.zeros((16, 2))
            np.add.at(left, c, np.eye(2) + w * u[:, :, None] * u[:, None, :])
            np.add.at(right, c, r + w * u * (others + (r * u).sum(1))[:, None])
            used = np.bincount(c, minlength=16) > 0
            words[s][used] = np.linalg.solve(left[used], right[used][:, :, None])[:, :, 0]
            if not used.all():
                words[s][~used] = r[rng.integers(0, n, int((~used).sum()))]
            total = others + ((r - words[s][c]) * u).sum(1)
    return words


def fit(x: np.ndarray, rows: int, k: int, leaf_rows: int = LEAF_ROWS, coverage: float = COVERAGE, threshold: float = THRESHOLD) -> Index:
    """The index of a table of `rows` distinct vectors from a sample x of them."""
    rng, d = np.random.default_rng(7), x.shape[1]
    width = 4 * math.ceil(d / 4)
    centres = _kmeans(x, max(1, min(round(rows / leaf_rows), len(x) // 16)), rng)
    # of the loss for inner products above the threshold: how much more the parallel part weighs
    weight = max(0.0, (d - 1) * threshold**2 / (1 - threshold**2) - 1)
    out = Index(centres, np.zeros((width // 2, 16, 2)), weight, 0.0, len(centres))
    leaf = out.leaves(x)
    out.words = _words(*_parts(x[:WORDS], centres[leaf[:WORDS]], width), weight, rng)
    lost = x - out.decode(out.encode(x, leaf), leaf)
    asked = x[:: max(1, len(x) // 256)]
    direction = asked / np.linalg.norm(asked, axis=1, keepdims=True)
    out.error = float(np.sqrt(np.mean((direction @ lost.T) ** 2)))
    if len(centres) > 1:
        place = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)
        score = asked @ x.T
        score[np.arange(len(asked)), np.arange(0, len(x), max(1, len(x) // 256))] = -np.inf
        best = np.argpartition(-score, min(k, len(x) - 1), axis=1)[:, :k]
        out.probes = int(np.quantile(np.take_along_axis(place, leaf[best], 1), coverage, method="higher")) + 1
    return out


def search(index: Index, q: np.ndarray, probed: np.ndarray, x: np.ndarray, codes: np.ndarray, leaf: np.ndarray, k: int, errors: float = ERRORS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query, entry and exact product of all entries of a block that can be among the k best, by table sums.

    probed (queries, leaves): which leaves a query looks into; entries come ordered by their leaf.
    """
    by_pair = np.ascontiguousarray(codes.T)
    norm, centre = np.linalg.norm(q, axis=1), q @ index.centres.T
    starts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
    ends = [*starts[1:], len(leaf)]
    step = max(1, min(64, (1 << 20) // (1 + len(x))))
    for i in range(0, len(q), step):
        table, unit = index.tables(q[i : i + step])
        sums = np.full((len(table), len(x)), -np.inf, np.float32)
        for a, b in zip(starts, ends, strict=True):
            own = np.flatnonzero(probed[i : i + step, leaf[a]])
            if len(own):
                total = np.zeros((len(own), b - a), table.dtype)
                for p, codes_p in enumerate(by_pair):
                    total += np.take(table[own, p], codes_p[a:b], axis=1)
                # in units of the query's tables
                sums[own, a:b] = total + (centre[i + own, leaf[a]] / unit[own])[:, None]
        kth = np.partition(sums, -k, axis=1)[:, -k] if len(x) > k else np.full(len(table), -np.inf)
        margin = errors * index.error * norm[i : i + step] / unit + len(by_pair)  # and the rounding of the tables
        qi, xi = np.nonzero((sums >= (kth - margin)[:, None]) & (sums > -np.inf))
        for a in range(0, len(qi), 1 << 15):
            yield i + qi[a : a + (1 << 15)], xi[a : a + (1 << 15)], (q[i + qi[a : a + (1 << 15)]] * x[xi[a : a + (1 << 15)]]).sum(1)


def _best(query: np.ndarray, ident: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which rows are the k best identifiers of their query, each identifier by its largest score."""
    order = np.lexsort((-score, ident, query))
    first = np.ones(len(order), bool)
    first[1:] = (query[order][1:] != query[order][:-1]) | (ident[order][1:] != ident[order][:-1])
    order = order[first]
    order = order[np.lexsort((ident[order], -score[order], query[order]))]
    begins = np.searchsorted(query[order], query[order])
    return order[np.arange(len(order)) - begins < k]


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten(), np.float64).reshape(len(col), -1)


def _vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and v of the rows that take part."""
    kind = table.schema[vec_col].dataType
    to = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    v = F.col(vec_col).cast(f"array<{to}>")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.where(F.col(id_col).isNotNull() & v.isNotNull()).where(usable)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: x + F.lit(0).cast(to)).alias("v"))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.where(F.size("v") == (lengths[0]["d"] if lengths else 0))


def _key() -> list[Column]:
    return [F.xxhash64(F.lit(i), "v").alias(f"q{i}") for i in (1, 2)]


def entries(rows: DataFrame, most: int) -> DataFrame:
    """One row per distinct vector with its `most` smallest identifiers.

    The limit holds before the exchange already, so a vector that a third of the rows have brings few from each task.
    """
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.distinct().withColumn("place", place).where(F.col("place") <= most)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("v", "ids", *_key())


def _sample(table: DataFrame, rows: int, d: int) -> np.ndarray:
    """At most SAMPLE vectors (SAMPLE_BYTES), by hash order."""
    size = max(16, min(SAMPLE, SAMPLE_BYTES // (8 * d)))
    share = min(1.0, 1.5 * size / rows + 0.001)
    few = table.where(F.pmod("q1", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy("q1").limit(size)
    return _matrix(few.select("v").toArrow()["v"])


def _bins(count: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each leaf, and the blocks of each bin: small leaves share a bin of one block, a large one has several blocks."""
    bins, blocks, room = [], [], 0
    for n in count:
        if n > room or n > block:
            blocks.append(max(1, -(-int(n) // block)))
            room = block if n <= block else 0
        bins.append(len(blocks) - 1)
        room -= min(room, int(n))
    return np.array(bins, np.int64), np.array(blocks, np.int64)


def nearest(table: DataFrame, asked: Column | str, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", leaf_rows: int = LEAF_ROWS, coverage: float = COVERAGE, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """The k nearest other rows (largest inner product) that are found for each row for which `asked`, a condition on vec_id, holds."""
    spark = table.sparkSession
    prepare(spark)
    rows = _vectors(table, id_col, vec_col)
    members = rows.where(asked).select("vec_id", *_key()).distinct()
    known = stash(entries(rows, k + 1), "vectors")
    n = known.count()
    if not n:
        return spark.createDataFrame([], SCHEMA)
    d = known.select(F.size("v")).first()[0]
    index = spark.sparkContext.broadcast(fit(_sample(known, n, d), n, k, leaf_rows, coverage))
    kind = known.schema["v"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                leaf = index.value.leaves(x)
                codes = index.value.encode(x, leaf)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], [*b.schema.names, "leaf", "codes"])

    coded = stash(known.mapInArrow(encode, f"v {kind}, ids array<long>, q1 long, q2 long, leaf int, codes binary"), "codes")
    drop(known)
    # at most one row per leaf, which the sample bounds
    sizes = {r["leaf"]: r["n"] for r in coded.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    count = np.array([sizes.get(i, 0) for i in range(len(index.value.centres))])
    block, chunk = (max(64, min(b, BLOCK_BYTES // (8 * d))) for b in (block, chunk))
    bins, blocks = _bins(count, block)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                order = np.argsort(-(_matrix(b.column(0)) @ index.value.centres.T), axis=1, kind="stable")
                # more leaves where the first are too small to hold k others
                there = np.cumsum(count[order], axis=1)
                most = np.maximum(index.value.probes, (there <= 2 * k).sum(1) + 1)
                leaves = [o[:m] for o, m in zip(order, most, strict=True)]
                cols = [pa.array(rows, pa.list_(pa.int32())) for rows in (leaves, [np.unique(bins[x]) for x in leaves])]
                yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, "leaves", "bins"])

    queries = coded.join(members.select("q1", "q2").distinct(), ["q1", "q2"], "left_semi").select("v", "q1", "q2")
    queries = stash(queries.mapInArrow(probe, f"v {kind}, q1 long, q2 long, leaves array<int>, bins array<int>"), "queries")
    wanted = {r["bin"]: r["n"] for r in queries.select(F.explode("bins").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    dealt = [(i, int(b), int(blocks[b]), -(-wanted[b] // chunk)) for i, b in enumerate(bins) if b in wanted]
    if not dealt:
        return spark.createDataFrame([], SCHEMA)
    by_leaf = spark.createDataFrame(dealt, "leaf int, bin int, blocks long, chunks long")
    part = lambda seed, of: F.pmod(F.xxhash64(F.lit(seed), "q1", "q2"), F.col(of))
    each = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    left = coded.join(F.broadcast(by_leaf), "leaf").select("bin", part(3, "blocks").alias("block"), each("chunks").alias("chunk"), "v", "ids", "codes", "leaf")
    right = queries.select("q1", "q2", "v", "leaves", F.explode("bins").alias("bin")).join(F.broadcast(by_leaf.drop("leaf").distinct()), "bin")
    right = right.select("bin", each("blocks").alias("block"), part(4, "chunks").alias("chunk"), "q1", "q2", "v", "leaves")

    def found(entry: pa.Table, query: pa.Table) -> pa.Table:
        names = ["q1", "q2", "vec_id", "score"]
        empty = pa.Table.from_arrays([pa.array([], pa.int64())] * 3 + [pa.array([], pa.float64())], names)
        if not entry.num_rows or not query.num_rows:
            return empty
        entry = entry.sort_by("leaf")
        x, q, leaf = _matrix(entry["v"]), _matrix(query["v"]), np.asarray(entry["leaf"])
        probed = np.zeros((len(q), len(index.value.centres)), bool)
        for i, own in enumerate(query["leaves"].to_pylist()):
            probed[i, own] = True
        codes = np.frombuffer(b"".join(entry["codes"].to_pylist()), np.uint8).reshape(len(x), -1)
        ids = entry["ids"].combine_chunks()
        values, starts = np.asarray(ids.flatten()), np.concatenate([[0], np.cumsum(np.asarray(ids.value_lengths()))])
        kept: list[tuple] = []
        held: list[tuple] = []
        for qi, xi, score in search(index.value, q, probed, x, codes, leaf, k + 1):
            many = np.diff(starts)[xi]
            at = np.repeat(starts[xi] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            held.append((np.repeat(qi, many), values[at], np.repeat(score, many)))
            if sum(len(h[0]) for h in held) > 1 << 18:
                held = [_cut(held, k + 1)]
                if len(held[0][0]) and held[0][0][0] != qi[-1]:  # queries come in order: all but the last are done
                    done = held[0][0] < qi[-1]
                    kept.append(tuple(c[done] for c in held[0]))
                    held = [tuple(c[~done] for c in held[0])]
        if held:
            kept.append(_cut(held, k + 1))
        qi, ident, score = (np.concatenate([h[i] for h in kept]) for i in range(3))
        q1, q2 = (np.asarray(query[c]) for c in ("q1", "q2"))
        return pa.Table.from_arrays([pa.array(q1[qi]), pa.array(q2[qi]), pa.array(ident), pa.array(score)], names)

    by = ["bin", "block", "chunk"]
    rows = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(found, "q1 long, q2 long, vec_id long, score double")
    order = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    best = rows.repartition("q1", "q2").groupBy("q1", "q2", "vec_id").agg(F.max("score").alias("score"))
    best = best.withColumn("rank", F.row_number().over(order("q1", "q2"))).where(F.col("rank") <= k + 1).drop("rank")
    # many queries may share a vector; each brings k + 1 narrow rows
    best = members.withColumnRenamed("vec_id", "query_id").join(best, ["q1", "q2"]).where("query_id <> vec_id")
    best = best.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = best.withColumn("rank", F.row_number().over(order("query_id"))).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _cut(held: list[tuple], k: int) -> tuple:
    """The k best identifiers of each query of some rows, ordered by query."""
    query, ident, score = (np.concatenate([h[i] for h in held]) for i in range(3))
    at = _best(query, ident, score, k)
    return query[at], ident[at], score[at]
