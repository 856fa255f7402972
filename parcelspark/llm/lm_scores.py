"""Stupid-backoff language model scores, as joins of n-gram rows with n-gram count tables.

    S(w | context) = c(context w) / c(context)            where c(context w) > 0
                     backoff * S(w | shorter context)     otherwise
    S(w)           = c(w) / N

with c the counts in the whole corpus and N its number of words; a document's first
words have shorter contexts. `lm_scores` scores the documents of the corpus itself.
Each of their n-grams is found there, so nothing backs off, and the log score of a
document is a sum over its n-grams: + log c of each one that ends a word's context,
- log c of each context (those of the first words cancel), - log N.

1. Documents are exploded to rows (hash, document, sign, times) of each n-gram that is
   counted, and exchanged by hash once. An n-gram that is common in a batch of texts
   has one row for a document and sign, however often it is there.
2. These rows are counted by hash, and joined with the counts where they lie. A count
   of one has the log 0, so only n-grams that occur again are in the table, and rows
   that find none there go no further. All rows of an n-gram that occurs everywhere
   are read by one task, as a stream; the table has one row of it.
3. Signed logs are summed per document, pre-aggregated before the exchange.

The rows are made and joined in `slices` passes over parts of the hash range. Each
pass reads the texts again, and its shuffle files are gone before the next, which
divides the disk needed, and the table that a task holds, by the number of passes.

`score_against` scores other texts with the count tables of a corpus, by joins at
each order in turn; there n-grams are missing and the model backs off. Words in no
document count as half an occurrence.

N-grams do not cross documents. Words are runs between ASCII white space. Hashes
have 64 bits. Defined cases: null and empty texts have no words and null scores;
equal rows are documents of their own, each with the score of its text; different
texts with equal or null identifiers are documents of their own; an empty table
gives an empty result. Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm import textkit as K
from parcelspark.llm.rowkeys import keyed
from parcelspark.scratch import prepare, stash

_STEP = K.U(0x9E3779B97F4A7C15)


def grams(words: np.ndarray, row: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order the hash of the n-gram that ends at each word; below a document's first n words it means nothing."""
    out = [words]
    for _ in range(1, order):
        h = np.zeros_like(words)
        h[1:] = K.mix(out[-1][:-1] * _STEP + K.mix(words[1:] ^ _STEP))
        out.append(h)
    return out


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    """Which of equal parts of the hash range each hash lies in."""
    return ((h >> K.U(32)) * K.U(parts)) >> K.U(32)


def _positions(row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of each word in its document, and the number of words there."""
    size = np.bincount(row, minlength=n_rows)
    return np.arange(len(row)) - (np.cumsum(size) - size)[row], size[row]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, word hashes and their rows, in parts of bounded size."""
    for b in batches:
        key = b.column(0).to_numpy(zero_copy_only=False)
        buf, off = K.flat(b.column(1))
        for i, j in K.groups(off, 2 << 20):
            h, r, _ = K.word_hashes(buf[off[i] : off[j]], off[i : j + 1] - off[i], ~K.SPACE)
            yield key[i:j], h, r


def _batch(names: str, *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names.split())


#: Distinct short texts up to which only their n-grams are counted at the lower orders.
MAX_SHORT = 100_000


def short_grams(rows: DataFrame, order: int) -> np.ndarray | None:
    """Sorted hashes of the texts of fewer than order - 1 words: all that the lower orders are asked for; None if they are too many to hold."""
    if order < 3:
        return np.zeros(0, K.U)
    prepare(rows.sparkSession)
    blank = r"[\x20\x09-\x0D]"
    few = rows.where(F.col("text").rlike(f"^{blank}*([^\\x20\\x09-\\x0D]+{blank}+){{0,{order - 3}}}[^\\x20\\x09-\\x0D]+{blank}*$"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, h, r in _words(batches):
            pos, size = _positions(r, len(key))
            for k, g in enumerate(grams(h, r, order - 2), 1):
                yield _batch("hash", g[(size == k) & (pos == k - 1)].view(np.int64))

    found = few.select("key", "text").mapInArrow(run, "hash long").distinct().limit(MAX_SHORT + 1).toPandas()["hash"].to_numpy(np.int64)
    return np.sort(found.view(K.U)) if len(found) <= MAX_SHORT else None


def count_rows(rows: DataFrame, orders: range, id_col: str = "key", text_col: str = "text") -> DataFrame:
    """(hash, n): occurrences of n-grams of the given orders, summed over each batch of documents."""
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some: list[np.ndarray] = []
            for key, h, r in _words([b]):
                pos, _ = _positions(r, len(key))
                some += [g[pos >= k - 1] for k, g in enumerate(grams(h, r, max(orders)), 1) if k in orders]
            h, n = np.unique(np.concatenate(some), return_counts=True) if some else (np.zeros(0, K.U), np.zeros(0, np.int64))
            yield _batch("hash n", h.view(np.int64), n)

    return rows.select(id_col, text_col).mapInArrow(run, "hash long, n long")


def count_table(rows: DataFrame, orders: range, id_col: str = "key", text_col: str = "text") -> DataFrame:
    """(hash, n): occurrences in the whole corpus, partitioned by hash."""
    return count_rows(rows, orders, id_col, text_col).groupBy("hash").agg(F.sum("n").alias("n"))


#: Occurrences of the n-grams of one remainder of the hashes from which on a document's rows of one n-gram are one.
COMMON = 64


def _merged(h: np.ndarray, row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash, row and code, and how often each occurs: common ones once for a row and code, but as they are where code >= 2."""
    n, keep = np.ones(len(h), np.int32), np.ones(len(h), bool)
    rest = (h & K.U(0xFFFF)).astype(np.int64)
    at = np.flatnonzero((np.bincount(rest, minlength=1 << 16) >= COMMON)[rest] & (code < 2))
    if len(at):
        o = at[np.lexsort((code[at], row[at], h[at]))]
        start = np.flatnonzero(np.concatenate([[True], (h[o][1:] != h[o][:-1]) | (row[o][1:] != row[o][:-1]) | (code[o][1:] != code[o][:-1])]))
        keep[o] = False
        keep[o[start]] = True
        n[o[start]] = np.diff(start, append=len(o))
    return h[keep], row[keep], code[keep], n[keep]


def signed_rows(rows: DataFrame, order: int, part: int, parts: int, low: np.ndarray | None = None) -> DataFrame:
    """(hash, key, code, times): rows of each n-gram of the two highest orders, and of the lower ones that are wanted.

    code is 1 for an n-gram and -1 for a context whose log count a document's score takes, 2 + the
    document's number of words on one n-gram of each document, and 0 for one that is only counted.
    low: the only hashes that are wanted below the two highest orders (None: all).
    """
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, h, r in _words(batches):
            pos, size = _positions(r, len(key))
            for k, g in enumerate(grams(h, r, order), 1):
                # the order-grams, or all words of a text that has fewer; contexts but those of the first words
                plus = pos >= order - 1 if k == order else (size == k) & (pos == k - 1)
                minus = (pos >= k) & (pos < size - 1) if k == order - 1 else np.zeros(len(g), bool)
                some = (pos >= k - 1) & (_part(g, parts) == part)
                if low is not None and k < order - 1:
                    some &= low[np.minimum(np.searchsorted(low, g), len(low) - 1)] == g if len(low) else False
                at = np.flatnonzero(some)
                code = np.where(plus[at], np.where(pos[at] == np.minimum(size[at], order) - 1, 2 + size[at], 1), np.where(minus[at], -1, 0))
                own, row, code, times = _merged(g[at], r[at], code)
                yield _batch("hash key code times", own.view(np.int64), key[row], code.astype(np.int32), times)

    return rows.select("key", "text").mapInArrow(run, "hash long, key long, code int, times int")


def with_counts(signed: DataFrame) -> DataFrame:
    """Rows whose hash occurs again, with its count n, and one n-gram of each document, with or without one; the rows are exchanged once."""
    # count and join read the same exchange, so neither may leave out columns or rows below it
    dealt = signed.where("hash IS NOT NULL").repartition("hash")
    table = dealt.groupBy("hash").agg(F.expr("sum(CASE WHEN key IS NOT NULL AND code IS NOT NULL THEN times END)").alias("n")).where("n > 1")
    return dealt.join(table.hint("shuffle_hash"), "hash", "left").where("n IS NOT NULL OR code >= 2")


#: Bytes of texts whose n-grams one partition of a pass holds as a table, and the least number of passes.
TABLE_BYTES, SLICES = 32 << 20, 3


def _slices(texts: DataFrame) -> int:
    """Passes over parts of the hash range, so that a task's table stays in bounds; the plan's estimate of the bytes, and where that is too much their sum."""
    room = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) * TABLE_BYTES
    size = int(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > room:
        size = texts.agg(F.coalesce(F.sum(F.octet_length(F.col(texts.columns[0]))), F.lit(0))).first()[0]
    return max(SLICES, -(-SLICES * size // room))


def lm_scores(docs: DataFrame, order: int = 3, id_col: str = "doc_id", text_col: str = "text", slices: int | None = None) -> DataFrame:
    """doc_id, n_words, log_score and its mean per word for every whole text of a corpus."""
    rows = keyed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    slices = slices or _slices(docs.select(text_col))
    # lower orders than order - 1 count for texts of so few words only
    low = short_grams(rows, order)
    code, sums = F.col("code"), None
    z = F.signum(F.col("code")) * F.col("times") * F.log(F.coalesce("n", F.lit(1)))
    for part in range(slices):
        # the table is the hashed side: a row per n-gram of this part that occurs again, over all partitions of the exchange
        joined = with_counts(signed_rows(rows, order, part, slices, low))
        own = stash(joined.groupBy("key").agg(F.sum(z).alias("z"), F.sum(F.greatest(code - 2, F.lit(0))).alias("words"), F.count_if(code >= 2).alias("copies")), "lm-sums")
        sums = own if sums is None else sums.unionByName(own)
    summed = stash(sums.groupBy("key").agg(F.sum("z").alias("z"), F.sum("words").alias("words"), F.sum("copies").alias("copies")), "lm-documents")
    total = summed.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    # -log N once for a document, or for each word where there are no contexts
    n = F.col("words") / F.col("copies")
    per = summed.select(F.col("key").alias("k"), n.cast("long").alias("n"), (F.col("z") / F.col("copies") - float(np.log(max(total, 1))) * (n if order == 1 else 1)).alias("z"))
    out = rows.select("doc_id", "key").join(per, F.expr("key = k"), "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_words"), F.col("z").alias("log_score"), (F.col("z") / F.col("n")).alias("mean_log_score"))


def score_against(docs: DataFrame, corpus: DataFrame, order: int = 3, backoff: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score of texts by the counts of another table, with backoff."""
    rows = keyed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    other = corpus.select(F.lit(0).alias("key"), F.col(text_col).alias("text"))
    total = count_rows(other, range(1, 2)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    table = stash(count_table(other, range(1, order + 1)), "lm-table").select(F.col("hash").alias("h"), F.col("n").alias("c"))
    names = [f"g{k}" for k in range(1, order + 1)] + [f"c{k}" for k in range(1, order)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, h, r in _words(batches):
            pos, _ = _positions(r, len(key))
            all_grams = grams(h, r, order)
            cols = [pa.array(g.view(np.int64), mask=pos < k) for k, g in enumerate(all_grams)]
            cols += [pa.array(np.concatenate([g[:1], g[:-1]]).view(np.int64), mask=pos <= k) for k, g in enumerate(all_grams[:-1])]
            # one row for each word: its n-grams and their contexts, by order
            yield pa.RecordBatch.from_arrays([pa.array(key[r]), *cols], ["key", *names])

    now = rows.dropDuplicates(["key"]).select("key", "text").mapInArrow(run, ", ".join(f"{x} long" for x in ["key", *names]))
    prepare(docs.sparkSession)
    for k in range(order, 0, -1):
        for name in ([f"g{k}", f"c{k - 1}"] if k > 1 else ["g1"]):
            found = f"n_{name}"
            if found not in now.columns:
                now = now.join(table.select("h", F.col("c").alias(found)), F.col(name) == F.col("h"), "left").drop("h")
    s = F.coalesce("n_g1", F.lit(0.5)) / max(total, 1)
    for k in range(2, order + 1):
        s = F.when(F.col(f"n_g{k}").isNotNull(), F.col(f"n_g{k}") / F.col(f"n_c{k - 1}")).when(F.col(f"g{k}").isNotNull(), backoff * s).otherwise(s)
    per = now.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.log(s)).alias("z"))
    out = rows.select("doc_id", "key").join(per, F.expr("key = k"), "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_words"), F.col("z").alias("log_score"), (F.col("z") / F.col("n")).alias("mean_log_score"))


SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS w3, generate_subscripts(ws, 1) AS i
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents)),
g AS (SELECT doc_id, i, w3, lag(w3, 1) OVER d AS w2, lag(w3, 2) OVER d AS w1 FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
n AS (
  SELECT *, count(*) OVER (PARTITION BY w3) AS c1,
    CASE WHEN i > 1 THEN count(*) OVER (PARTITION BY w2, w3, i > 1) END AS c2,
    CASE WHEN i > 2 THEN count(*) OVER (PARTITION BY w1, w2, w3, i > 2) END AS c3,
    count(*) OVER () AS total
  FROM g),
s AS (SELECT *, lag(c1) OVER d AS b1, lag(c2) OVER d AS b2 FROM n WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT doc_id, CASE WHEN i > 2 THEN c3 / b2 WHEN i > 1 THEN c2 / b1 ELSE c1 / total END AS p FROM s)
SELECT d.doc_id, coalesce(x.n, 0) AS n_words, round(x.z, 4) AS log_score, round(x.z / x.n, 6) AS mean_log_score
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, sum(ln(p)) AS z FROM t GROUP BY doc_id) x ON d.doc_id = x.doc_id
"""
