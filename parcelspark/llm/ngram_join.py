"""Near-duplicate join: Jaccard similarity of word 5-gram sets by MinHash banding.

1. Every document gets a key of its word sequence and its band hashes. Equal word
   sequences collapse to the smallest key, so copies cost one row per task.
2. Bands and rows are the widest bands that reach the target recall at the
   threshold. Representatives are shuffled on band hashes; the first of a bucket
   is linked to the others (a star, not all pairs). Components of these stars hold
   every candidate pair.
3. Candidates are verified on their full sets of n-gram hashes. A component within
   the block bounds is one group. In a larger one each band bucket is a group, so
   that only pairs that share a bucket are compared, each in the first band that it
   shares; a bucket whose members also share an earlier band holds no such pair and
   is left out. A bucket beyond the block bounds is cut into blocks and each pair
   of blocks is one group, so no group grows with the data. Links are counted per
   document and each group returns a spanning forest, not its pairs.
4. Classes are the components of those forests: documents joined by links.

Words are runs between ASCII white space, compared as they are. Defined cases:
null text counts as empty; texts without words are equal to each other and have
no links; a text of one to four words has one n-gram, all of them; rows with null or
repeated identifiers take part by a key of identifier and text (see rowkeys), which
is also their class where no plain identifier is in it; an empty table gives an
empty result. Other input columns are ignored, and kept by `one_of_each`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm import textkit as K
from parcelspark.llm.rowkeys import keyed, side
from parcelspark.operators.components import components
from parcelspark.scratch import prepare, stash

_SEEDS = np.random.default_rng(77).integers(1, 2**32, (2, 512), dtype=np.uint32)


def choose_bands(threshold: float, recall: float, max_hashes: int = 192) -> tuple[int, int]:
    """Bands and rows: the most rows per band for which enough bands for the recall fit into max_hashes."""
    best = None
    for rows in range(1, max_hashes + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else max(1, math.ceil(math.log1p(-recall) / math.log1p(-hit)))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("max_hashes is too small for this recall")
    return best


def minhash(sh: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """(n_rows, k) minima of k hash functions over each row's n-grams; rows must ascend."""
    out = np.full((n_rows, k), 0xFFFFFFFF, np.uint32)
    for a in range(0, len(sh), 16384):
        h, r = sh[a : a + 16384], row[a : a + 16384]
        lo, hi = (h & K.U(0xFFFFFFFF)).astype(np.uint32), (h >> K.U(32)).astype(np.uint32)
        starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        at = r[starts]
        for i in range(k):
            x = (hi if i % 2 else lo) * (_SEEDS[0, i] | np.uint32(1)) + _SEEDS[1, i]
            out[at, i] = np.minimum(out[at, i], np.minimum.reduceat(x, starts))
    return out


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) 64-bit keys that include the band's number."""
    out = np.zeros((len(sig), bands), K.U)
    for b in range(bands):
        h = np.full(len(sig), b + 1, K.U)
        for i in range(b * rows, (b + 1) * rows):
            h = K.mix(h * K.U(0x9E3779B97F4A7C15) + sig[:, i].astype(K.U))
        out[:, b] = h
    return out


def _keys(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """(n, 2) hashes of each row's word sequence."""
    counts = np.bincount(row, minlength=n)
    pos = (np.arange(len(h)) - np.concatenate([[0], np.cumsum(counts)])[row]).astype(K.U)
    out = np.zeros((n, 2), K.U)
    if len(h):
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        for c, seed in enumerate((0x51ED270B, 0xA24BAED5)):
            out[row[starts], c] = np.add.reduceat(K.mix(h ^ K.mix(pos + K.U(seed))), starts)
    return out


def sketch(own: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, key, k1, k2 (its word sequence), bands (null without words)."""
    prepare(own.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = K.flat(b.column(2))
            for i, j in K.groups(off, 1 << 20):
                h, r, _ = K.word_hashes(buf[off[i] : off[j]], off[i : j + 1] - off[i], ~K.SPACE)
                keys = _keys(h, r, j - i)
                sh, sr = K.shingle_hashes(h, r, j - i, n)
                hashes = band_hashes(minhash(sh, sr, j - i, bands * rows), bands, rows)
                some = np.bincount(r, minlength=j - i) > 0
                cuts = pa.array(np.arange(0, (j - i + 1) * bands, bands, dtype=np.int32))
                lists = pa.ListArray.from_arrays(cuts, pa.array(hashes.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(keys[:, 0].view(np.int64)), pa.array(keys[:, 1].view(np.int64)), pa.compute.if_else(pa.array(some), lists, pa.scalar(None, lists.type))], ["doc_id", "key", "k1", "k2", "bands"])

    return own.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key long, k1 long, k2 long, bands array<long>")


def gram_sets(texts: DataFrame, n: int) -> DataFrame:
    """rep, root, grams: the sorted distinct n-gram hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = K.flat(b.column(2))
            for i, j in K.groups(off, 1 << 20):
                h, r, _ = K.word_hashes(buf[off[i] : off[j]], off[i : j + 1] - off[i], ~K.SPACE)
                sh, sr = K.shingle_hashes(h, r, j - i, n)
                o = np.lexsort((sh, sr))
                sh, sr = sh[o], sr[o]
                first = np.ones(len(sh), bool)
                first[1:] = (sh[1:] != sh[:-1]) | (sr[1:] != sr[:-1])
                sh, sr = sh[first], sr[first]
                cuts = np.searchsorted(sr, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.ListArray.from_arrays(cuts, sh.view(np.int64))], ["rep", "root", "grams"])

    return texts.select("rep", "root", "text").mapInArrow(run, "rep long, root long, grams array<long>")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted unique arrays."""
    n = len(sets)
    if n <= 8:
        out = np.zeros((n, n))
        for i in range(n):
            for j in range(i + 1, n):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, col, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df[col] > 1
    row, col = row[shared], (np.cumsum(df > 1) - 1)[col[shared]]
    o = np.argsort(col, kind="stable")
    row, col = row[o], col[o]
    out = np.zeros((n, n), np.float32)
    width = max(256, (4 << 20) // n)
    for a in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        lo, hi = np.searchsorted(col, [a, a + width])
        m = np.zeros((n, min(width, int(col[-1]) + 1 - a)), np.float32)
        m[row[lo:hi], col[lo:hi] - a] = 1
        out += m @ m.T
    return out


def links(sets: list[np.ndarray], side: np.ndarray, cross: bool, threshold: float, bands: np.ndarray | None = None, band: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Number of links of each set, and the first set of its connected part.

    cross: only between sides. bands: only pairs whose first common band is `band`.
    """
    size = np.array([len(s) for s in sets], float)
    both = overlaps(sets)
    union = size[:, None] + size[None, :] - both
    linked = (both >= threshold * union - 1e-9) & (union > 0)
    np.fill_diagonal(linked, False)
    if cross:
        linked &= side[:, None] != side[None, :]
    for b in range(band):
        linked &= bands[:, b, None] != bands[None, :, b]
    label = np.arange(len(sets))
    while True:
        near = np.where(linked, label[None, :], len(sets)).min(1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return linked.sum(1), label
        label = new


GROUP = ["band", "group", "bi", "bj"]


def verify(groups: DataFrame, threshold: float) -> DataFrame:
    """rep, links, root of each group; rows must come sorted by group. Columns: GROUP, rep, block, bands, grams."""

    def finish(key: tuple, reps: list[int], blocks: list[int], bands: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        known = np.array(bands) if key[0] > 0 else None
        count, label = links(sets, np.array(blocks), key[2] != key[3], threshold, known, key[0])
        ids = np.array(reps)
        m = count > 0
        return pa.RecordBatch.from_arrays([pa.array(ids[m]), pa.array(count[m].astype(np.int64)), pa.array(ids[label[m]])], ["rep", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reps, blocks, bands, sets, seen = None, [], [], [], [], set()
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(7)]
            for *now, rep, block, marks, grams in zip(*cols, b.column(7), strict=True):
                if tuple(now) != key:
                    if len(reps) > 1:
                        yield finish(key, reps, blocks, bands, sets)
                    key, reps, blocks, bands, sets, seen = tuple(now), [], [], [], [], set()
                if rep in seen:  # a repeated row: equal identifier and text
                    continue
                seen.add(rep)
                reps.append(rep)
                blocks.append(block)
                bands.append(marks)
                sets.append(grams.values.to_numpy().view(K.U))
        if len(reps) > 1:
            yield finish(key, reps, blocks, bands, sets)

    return groups.select(*GROUP, "rep", "block", "bands", "grams").mapInArrow(run, "rep long, links long, root long")


def _groups(sets: DataFrame, reps: DataFrame, bands: int, block_docs: int, block_grams: int) -> DataFrame:
    """The rows of each group that is verified: GROUP, rep, block, bands, grams."""
    spark = sets.sparkSession
    size = F.size("grams").cast("long")
    roots = stash(sets.groupBy("root").agg((F.countDistinct("rep") > block_docs).alias("many"), (F.sum(size) > block_grams).alias("wide")).where("many OR wide").select(F.col("root").alias("large")), "large")
    one = F.lit(0)
    if roots.isEmpty():
        out = sets.withColumns({"band": F.lit(-1), "group": F.col("root"), "bi": one, "bj": one, "block": one, "bands": F.lit(None).cast("array<long>")})
    else:
        wide = side(roots)
        out = sets.join(wide, F.expr("root = large"), "left_anti").withColumns({"band": F.lit(-1), "group": F.col("root"), "bi": one, "bj": one, "block": one, "bands": F.lit(None).cast("array<long>")})
        inner = sets.join(wide, F.expr("root = large"), "left_semi").dropDuplicates(["rep"])
        # joins on rep make one row of each; its buckets are an array there
        marked = stash(inner.select("rep", size.alias("grams_n")).join(reps.select("rep", "bands"), "rep"), "marked")
        every = marked.select("rep", "bands", "grams_n", F.posexplode("bands").alias("band", "group"))
        # the members of a bucket share an earlier band where its least and largest hash are the same
        same = [(F.min(F.get("bands", F.lit(i))) == F.max(F.get("bands", F.lit(i)))).alias(f"same{i}") for i in range(bands)]
        sized = every.groupBy("group", "band").agg(F.count(F.lit(1)).alias("docs"), F.sum("grams_n").alias("grams_n"), *same)
        earlier = F.exists(F.slice(F.array(*(f"same{i}" for i in range(bands))), F.lit(1), F.col("band")), lambda x: x)
        blocks = F.greatest(F.ceil(F.col("docs") / block_docs), F.ceil(F.col("grams_n") / block_grams)).cast("int")
        kept = stash(sized.where((F.col("docs") > 1) & ~earlier).select("group", blocks.alias("nb")), "buckets")
        places = every.select("rep", "bands", "band", "group").join(side(kept), "group").groupBy("rep").agg(F.first("bands").alias("bands"), F.collect_list(F.struct("band", "group", "nb")).alias("places"))
        placed = inner.select("rep", "grams").join(places, "rep").select("rep", "bands", "grams", F.explode("places").alias("p"))
        placed = placed.select("rep", "bands", "grams", "p.*").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        placed = placed.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")})
        out = out.select(*GROUP, "rep", "block", "bands", "grams").unionByName(placed.select(*GROUP, "rep", "block", "bands", "grams"))
    rows = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = out.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return out.repartition(max(rows, -(-held // (8 << 20))), *GROUP).sortWithinPartitions(*GROUP)


def classes(own: DataFrame, n: int, threshold: float, recall: float, block_docs: int, block_grams: int) -> DataFrame:
    """doc_id, key, class_id, n_links, rep_id for rows (doc_id, key, text)."""
    bands, rows = choose_bands(threshold, recall)
    marks = stash(sketch(own, n, bands, rows), "sketch")
    reps = stash(marks.groupBy("k1", "k2").agg(F.min("key").alias("rep"), F.min_by("bands", "key").alias("bands")), "sequences")
    every = reps.select("rep", F.posexplode("bands").alias("band", "group"))
    centre = every.groupBy("group").agg(F.min("rep").alias("dst"), F.max("rep").alias("top")).where("dst < top").select("group", "dst")
    buckets = stash(every.join(centre, "group"), "buckets")
    candidates = stash(components(buckets.where("rep <> dst").select(F.col("rep").alias("src"), "dst")), "candidates")
    texts = own.select(F.col("key").alias("rep"), "text").join(side(candidates.withColumnRenamed("node", "rep")), "rep")
    sets = stash(gram_sets(texts, n), "gram-sets")
    found = stash(verify(_groups(sets, reps, bands, block_docs, block_grams), threshold), "links")
    roots = components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    counted = found.groupBy("rep").agg(F.sum("links").alias("n_links"))
    linked = roots.withColumnRenamed("node", "rep").join(counted, "rep")
    named = reps.select("k1", "k2", "rep").join(linked, "rep", "left")
    named = named.select(F.col("k1").alias("a"), F.col("k2").alias("b"), F.col("rep").alias("rep_id"), F.coalesce("root", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    # one key may hold a third of all rows; narrow rows, split by adaptive execution
    return marks.select("doc_id", "key", "k1", "k2").join(named, F.expr("k1 = a AND k2 = b")).select("doc_id", "key", "class_id", "n_links", "rep_id")


def jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text", block_docs: int = 512, block_grams: int = 4 << 20) -> DataFrame:
    """doc_id, class_id (documents joined by links or equality), n_links (to different texts), rep_id (equal texts)."""
    own = keyed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return classes(own, n, threshold, recall, block_docs, block_grams).drop("key")


def one_of_each(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text", block_docs: int = 512, block_grams: int = 4 << 20) -> DataFrame:
    """The rows of docs, all columns, that have the smallest key of their class; one of repeated rows."""
    own = keyed(docs, id_col, text_col, "__class_key")
    rows = own.select(F.col(id_col).cast("long").alias("doc_id"), F.col("__class_key").alias("key"), F.col(text_col).alias("text"))
    found = stash(classes(rows, n, threshold, recall, block_docs, block_grams).select("key", "class_id"), "classes")
    gone = stash(found.where("key <> class_id").select(F.col("key").alias("__class_gone")).distinct(), "dropped")
    kept = own.join(side(gone), F.expr("__class_key = __class_gone"), "left_anti")
    again = stash(found.where("key = class_id").groupBy("key").count().where("count > 1").select(F.col("key").alias("__class_again")), "repeated")
    n_again = again.count()
    if n_again:
        same = F.expr("__class_key = __class_again")
        once = kept.join(side(again, n_again), same, "left_semi").dropDuplicates(["__class_key"])
        kept = kept.join(side(again, n_again), same, "left_anti").unionByName(once)
    return kept.select(*docs.columns)
