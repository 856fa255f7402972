"""Exact deduplication with a log-structured merge index (DataFrame operations only).

One scan of the texts writes the log: (identifier, digest) of every row. Memtables of
the log are aggregated by digest and flushed as sorted runs (digest, smallest
identifier, number of rows) into level 0, each with a filter: a bitmap over hashes of
its digests, made and probed with Spark's bitmap functions. When a level holds
`fanout` runs, they are compacted into one run of the next level, which keeps the
smallest identifier; there each run's rows meet the filters of the others, and only
rows that pass are exchanged. What is asked of the index meets the filters as well:
rows of the log probe the filter of the digests with several rows, so documents
without a copy are never exchanged.
Every hit is verified on its bytes: the hits' texts are grouped by (digest, text),
which compares whole texts and pre-aggregates before the shuffle, so a group of
copies that holds a third of all rows costs one row per task. Digests with two
different texts get classes of their own.

Defined cases: null text counts as empty; rows equal in doc_id and text are one
document and one row of the result, while group_size counts each; a null doc_id never wins against an
identifier; an empty table gives an empty result. Other input columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.rowkeys import side
from parcelspark.scratch import drop, stash

#: Runs of these characters count as one space.
BLANKS = r"[\x20\x09-\x0D]+"
#: Bits of a filter per digest, bits of one row of Spark's bitmap functions, and rows of a filter that are broadcast at most (4 KB each).
FILTER_BITS, BITMAP_BITS, FILTER_ROWS = 16, 32768, 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, " ")


class Filter:
    """Bitmaps over hashes of digests: a digest that does not pass is not in the table."""

    def __init__(self, digests: DataFrame, count: int):
        # beyond FILTER_ROWS a bit stands for more digests, and more rows pass that are not there
        self.buckets = min(FILTER_ROWS, max(1, -(-count * FILTER_BITS // BITMAP_BITS)))
        place = self._place(F.col("digest"))
        self.bits = stash(digests.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")), "digest-filter")

    def _place(self, digest: Column) -> Column:
        return F.pmod(F.xxhash64(digest), F.lit(self.buckets * BITMAP_BITS)) + 1

    def passing(self, rows: DataFrame) -> DataFrame:
        """rows (with a column digest) and `passes`."""
        place = self._place(F.col("digest"))
        bit = F.bitmap_bit_position(place)
        byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        # bounded: at most FILTER_ROWS rows of 4 KB
        met = rows.join(F.broadcast(self.bits), F.bitmap_bucket_number(place) == F.col("bucket"), "left")
        return met.select(*rows.columns, F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False)).alias("passes"))


class DigestIndex:
    """Levels of sorted runs (digest, keep_id, group_size) with their filters."""

    def __init__(self, digest_bytes: int = 32, fanout: int = 2):
        self.digest_bytes, self.fanout = digest_bytes, fanout
        self.levels: list[list[tuple[DataFrame, Filter]]] = []
        self.texts: list[DataFrame] = []

    def digest(self, sha: Column) -> Column:
        """The leading bytes of sha256; tests shorten it to force collisions."""
        return F.substring(sha, 1, self.digest_bytes)

    def log(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """doc_id, sha, digest of every row, from one scan of the texts."""
        sha = F.unhex(F.sha2(normalised(F.col(text_col)), 256))
        rows = stash(docs.select(F.col(id_col).cast("long").alias("doc_id"), sha.alias("sha")), "digest-log")
        return rows.withColumn("digest", self.digest(F.col("sha")))

    def _run(self, merged: DataFrame) -> tuple[DataFrame, Filter]:
        run = stash(merged.sortWithinPartitions("digest"), "digest-run")
        return run, Filter(run.select("digest"), run.count())

    def _merge(self, runs: list[tuple[DataFrame, Filter]]) -> tuple[DataFrame, Filter]:
        """One run of several: only what another run's filter lets pass is exchanged, the rest is in one run alone."""
        alone, maybe = [], []
        for i, (rows, _) in enumerate(runs):
            met = rows.withColumn("__met", F.lit(False))
            for j, (_, other) in enumerate(runs):
                if j != i:
                    met = other.passing(met).select(*rows.columns, (F.col("__met") | F.col("passes")).alias("__met"))
            alone.append(met.where("NOT __met").drop("__met"))
            maybe.append(met.where("__met").drop("__met"))
        same = reduce(DataFrame.unionByName, maybe).groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        out = self._run(reduce(DataFrame.unionByName, [*alone, same]))
        for r, f in runs:
            drop(r, f.bits)
        return out

    def flush(self, memtable: DataFrame) -> None:
        """Adds rows of a log as a run of level 0, and compacts the levels that are full."""
        self._add(0, self._run(memtable.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))))

    def _add(self, level: int, run: tuple[DataFrame, Filter]) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._add(level + 1, self._merge(full))

    def compact(self) -> DataFrame:
        """Merges all levels into one run; the smallest identifier of each digest stays."""
        runs = [r for level in self.levels for r in level]
        if len(runs) > 1:
            self.levels = [[], [self._merge(runs)]]
            runs = self.levels[1]
        return runs[0][0]

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Indexes a table, whose texts stay at hand for the verification of hits."""
        self.texts.append(docs.select(F.col(id_col).cast("long").alias("keep_id"), normalised(F.col(text_col)).alias("kept")))
        self.flush(self.log(docs, id_col, text_col))

    def lookup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id and keep_id, the smallest indexed identifier (null: none) whose text has the same bytes."""
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
        rows = stash(rows.withColumn("digest", self.digest(F.unhex(F.sha2("norm", 256)))), "digest-probes")
        hits = None
        for level in self.levels:
            for run, met in level:
                own = met.passing(rows.select("digest").distinct()).where("passes").join(run.select("digest"), "digest", "left_semi").select("digest")
                hits = own if hits is None else hits.unionByName(own)
        if hits is None:
            return rows.select("doc_id", F.lit(None).cast("long").alias("keep_id"))
        texts = reduce(DataFrame.unionByName, self.texts).withColumn("digest", self.digest(F.unhex(F.sha2("kept", 256))))
        # bytes are compared: an indexed text counts only where it is the same
        same = texts.join(side(stash(hits.distinct(), "digest-hits")), "digest", "left_semi").groupBy("digest", "kept").agg(F.min("keep_id").alias("keep_id"))
        return rows.alias("r").join(same.alias("s"), F.expr("r.digest = s.digest AND norm = kept"), "left").select("doc_id", "keep_id")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32, memtables: int = 4) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per document, dropped ones too."""
    index = DigestIndex(digest_bytes)
    log = index.log(docs, id_col, text_col)
    for i in range(memtables):
        index.flush(log.where(F.pmod(F.xxhash64("digest", "doc_id"), F.lit(memtables)) == i))
    multi = stash(index.compact().where("group_size > 1"), "digest-multi")
    n_multi = multi.count()
    met = Filter(multi.select("digest"), n_multi).passing(log)
    # one digest may hold a third of the rows: where the copies are many, the left side is narrow and
    # unaggregated below the join's own exchange, so adaptive execution splits such a partition
    maybe = met.where("passes").join(side(multi, n_multi), "digest", "left").select("digest", "sha", "doc_id", "keep_id", "group_size")
    hits = stash(maybe.where("group_size IS NOT NULL").distinct(), "digest-hits")
    alone = met.where("NOT passes").select("sha", "doc_id").unionByName(maybe.where("group_size IS NULL").select("sha", "doc_id"))
    alone = alone.select("sha", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    texts = texts.join(side(hits.select(F.col("doc_id").alias("h")).distinct()), F.expr("doc_id <=> h"), "left_semi").withColumn("full", F.unhex(F.sha2("norm", 256))).withColumn("digest", index.digest(F.col("full")))
    # whole texts are compared; grouped before the exchange, a copy costs one row per task
    classes = stash(texts.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.first("full").alias("sha")).drop("norm"), "digest-classes")
    verified = classes.join(side(multi.select("digest"), n_multi), "digest", "left_semi")
    clash = stash(verified.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "digest-clash")
    if clash.isEmpty():
        drop(clash)
        same = hits
    else:
        split = hits.join(clash, "digest", "left_semi").select("digest", "sha", "doc_id").join(verified.select("digest", "sha", "keep_id", "group_size"), ["digest", "sha"])
        same = hits.join(clash, "digest", "left_anti").unionByName(split.select(hits.columns))
    out = alone.unionByName(same.select(alone.columns))
    return out.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stay: one of each group of equal normalised texts, also of rows that are repeated."""
    found = stash(exact_dedup(docs, id_col, text_col).where("group_size > 1").select("doc_id", "text_sha256", "kept"), "copies")
    own = docs.withColumn("__copy_sha", F.lower(F.sha2(normalised(F.col(text_col)), 256)))
    same = (F.col(id_col).cast("long").eqNullSafe(F.col("__copy_id"))) & (F.col("__copy_sha") == F.col("__copy_of"))
    pick = lambda kept: side(found.where(F.col("kept") == kept).select(F.col("doc_id").alias("__copy_id"), F.col("text_sha256").alias("__copy_of")))
    rest = own.join(pick(False), same, "left_anti")
    first = pick(True)
    # rows that are repeated, and so all kept, are among those with copies
    once = rest.join(first, same, "left_semi").dropDuplicates([id_col, "__copy_sha"])
    return rest.join(first, same, "left_anti").unionByName(once).select(*docs.columns)


SQL = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
"""
