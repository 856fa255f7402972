"""Toxicity scores from non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, documents without any label the
unlabelled rest. A linear model over the presence of words and word beginnings
minimises the class-prior-corrected risk

    prior * E_pos[l(f)] + max(0, E_unl[l(-f)] - prior * E_pos[l(-f)])

with the logistic loss; when the second part turns negative its gradient is
ascended instead. The prior is the toxic share of the labelled training rows.
The fit uses bounded samples (max_pos, max_unl documents in hash order, whole
texts). Its features are the max_terms terms of the sample that tell the two classes
apart best: by the prior the share of documents with a term among the negatives is
(share among unlabelled - prior * share among positives) / (1 - prior), and the
distance of the square roots of the two shares ranks the terms, toxic and harmless
ones alike. Scoring covers every whole text.

Defined cases: null and empty texts get the score of a text without known terms;
without any positive every score is 0; where every training text has a label all
of them, without regard to it, are the unlabelled rest; null labels are no labels; a document
with any label 1 is a positive; an identifier with several rows is learned from by one
of its texts. Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.llm import textkit as K
from parcelspark.scratch import drop, prepare, stash

PREFIXES = (3, 4, 5, 6, 7)
SCHEMA = "doc_id long, score double"


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def terms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each lower-case word made of letters and of its first 3 to 7 characters."""
    hs, rs = [], []
    low = K.LOWER[buf]
    for a, b, base in _blocks(off, 1 << 20):
        part = low[a:b]
        lo = base
        hi = int(np.searchsorted(off, b, "left"))
        s, e, r = K.words(part, np.clip(off[lo : hi + 1], a, b) - a, K.LETTER)
        rh = K.RangeHash(part)
        hs.append(rh(s, e))
        rs.append(r + lo)
        begins = np.flatnonzero(part & 0xC0 != 0x80)  # characters
        first, n = np.searchsorted(begins, s), len(begins)
        for k in PREFIXES:
            cut = begins[np.minimum(first + k, n - 1)] if n else s
            m = (first + k < n) & (cut < e)
            hs.append(rh(s[m], cut[m]) ^ K.U(k))
            rs.append(r[m] + lo)
    if not hs:
        return np.zeros(0, K.U), np.zeros(0, np.int64)
    return np.concatenate(hs), np.concatenate(rs)


def _blocks(off: np.ndarray, limit: int) -> Iterator[tuple[int, int, int]]:
    """Byte ranges of whole rows, or one longer row, with their first row."""
    for i, j in K.groups(off, limit):
        if off[j] > off[i]:
            yield int(off[i]), int(off[j]), i


@dataclass
class Model:
    """Sorted term hashes with their weights."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        z = np.full(n, self.bias)
        for i, j in K.groups(off, 1 << 20):
            h, r = terms(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            h, r = known(self.keys, h, r)
            if len(h):
                pair = np.unique(r * len(self.keys) + h)
                z[i:j] += np.bincount(pair // len(self.keys), weights=self.weights[pair % len(self.keys)], minlength=j - i)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def known(keys: np.ndarray, h: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index in keys and row of the hashes that keys holds."""
    if not len(keys) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen = np.zeros(1 << 20, bool)
    seen[(keys >> K.U(44)).astype(np.int64)] = True
    m = seen[(h >> K.U(44)).astype(np.int64)]
    h, r = h[m], r[m]
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    m = keys[at] == h
    return at[m], r[m]


def risk(w: np.ndarray, col: np.ndarray, row: np.ndarray, n_pos: int, n: int, prior: float) -> tuple[float, float, np.ndarray]:
    """Both parts of the risk, the second one as it is before the bound, and the gradient that a step goes down.

    w: weights, and the bias last; row: documents, the n_pos positives first. Where the
    second part is negative the gradient is that of its negative: the step ascends it.
    """
    is_pos = np.arange(n) < n_pos
    z = np.bincount(row, weights=w[col], minlength=n) + w[-1]
    up = 1 / (1 + np.exp(-np.clip(z, -60, 60)))  # derivative of l(-z); that of l(z) is up - 1
    as_neg_loss = np.logaddexp(0, z)
    first = prior * np.logaddexp(0, -z)[is_pos].mean()
    second = as_neg_loss[~is_pos].mean() - prior * as_neg_loss[is_pos].mean()
    as_neg = np.where(is_pos, -prior * up / n_pos, up / (n - n_pos))
    as_pos = np.where(is_pos, prior * (up - 1) / n_pos, 0)
    g = as_pos + as_neg if second >= 0 else -as_neg
    return float(first), float(second), np.concatenate([np.bincount(col, weights=g[row], minlength=len(w) - 1), [g.sum()]])


def fit_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], n_terms: int, prior: float, epochs: int = 250, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias from the term indices of each document; full-batch Adam."""
    both = [*pos, *unl]
    col = np.concatenate(both) if both else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    w = np.zeros(n_terms + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, epochs + 1):
        _, _, grad = risk(w, col, row, len(pos), len(both), prior)
        grad[:-1] += decay * w[:-1]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def training_rows(docs: DataFrame, marks: DataFrame, train_on: Column, id_col: str, text_col: str, max_pos: int, max_unl: int) -> DataFrame:
    """p (1: positive, 0: unlabelled) and text of at most max_pos + max_unl identifiers, one row each; marks: doc_id, y."""
    # an identifier counts once, however many rows it has
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).where(train_on & F.col("doc_id").isNotNull()).distinct()
    pick = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    rest = ids.join(marks, "doc_id", "left_anti")
    if rest.isEmpty():
        rest = ids  # every text has a label; all of them, without regard to it, stand for the unlabelled
    # two samples of documented size: at most max_pos + max_unl identifiers
    sample = pick(marks.where("y = 1").select("doc_id"), max_pos).withColumn("p", F.lit(1)).unionByName(pick(rest, max_unl).withColumn("p", F.lit(0)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    # and brings one text, the first by hash; pre-aggregated, so that its rows do not meet in one task
    return rows.groupBy("doc_id", "p").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("p", "text")


def train(docs: DataFrame, labels: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_pos: int = 3000, max_unl: int = 6000, max_terms: int = 8192, min_docs: int = 4) -> Model:
    """train_on: which identifiers (column doc_id) may be learned from, labels and texts."""
    spark = docs.sparkSession
    prepare(spark)
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(train_on & F.col("y").isNotNull() & F.col("doc_id").isNotNull())
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y"))
    share = marks.agg(F.avg("y")).first()[0]
    if not share:
        return Model(np.zeros(0, K.U), np.zeros(0), -60.0)
    prior = min(max(float(share), 1e-3), 0.9)
    rows = training_rows(docs, marks, train_on, id_col, text_col, max_pos, max_unl)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = K.flat(b.column(1))
            p = b.column(0).to_numpy(zero_copy_only=False)
            for i, j in K.groups(off, 1 << 20):
                h, r = terms(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                o = np.lexsort((h, r))
                h, r = h[o], r[o]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                h, r = h[first], r[first]
                cuts = np.searchsorted(r, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(p[i:j].astype(np.int32)), pa.ListArray.from_arrays(cuts, h.view(np.int64))], ["p", "terms"])

    found = stash(rows.mapInArrow(extract, "p int, terms array<long>"), "toxic-terms")
    n_pos, n_unl = (found.where(f"p = {k}").count() for k in (1, 0))
    if not n_pos or not n_unl:
        drop(found)
        return Model(np.zeros(0, K.U), np.zeros(0), -60.0)
    shares = found.select("p", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("p").alias("a"), F.sum(1 - F.col("p")).alias("b"))
    p = F.col("a") / n_pos
    q = F.greatest((F.col("b") / n_unl - prior * p) / (1 - prior), F.lit(0.0))
    some = shares.where(F.col("a") + F.col("b") >= min_docs)
    # at most max_terms rows
    best = some.orderBy(F.abs(F.sqrt(p) - F.sqrt(q)).desc(), "term").limit(max_terms).toPandas()["term"].to_numpy(np.int64)
    keys = np.sort(best.view(K.U))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            h = lists.flatten().to_numpy().view(K.U)
            r = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths().fill_null(0)))
            at, r = known(keys, h, r)
            cuts = np.searchsorted(r, np.arange(len(lists) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(cuts, pa.array(at.astype(np.int32)))], ["p", "terms"])

    data = found.mapInArrow(narrow, "p int, terms array<int>").toArrow()
    drop(found)
    p = data["p"].to_numpy()
    lists = data["terms"].combine_chunks()
    docs_at = np.split(lists.flatten().to_numpy().astype(np.int64), np.cumsum(np.asarray(lists.value_lengths()))[:-1])
    order = np.argsort(-p, kind="stable")
    weights, bias = fit_nnpu([docs_at[i] for i in order if p[i]], [docs_at[i] for i in order if not p[i]], len(keys), prior)
    return Model(keys, weights, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every whole text."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = K.flat(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(buf, off))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of held-out documents are never read into the fit."""
    out = held_out(F.col("doc_id"))
    scored = score(docs, train(docs, labels, ~out))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold."""
    prepare(docs.sparkSession)
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = K.flat(b.column(at))
            yield b.filter(pa.array(model.scores(buf, off) < threshold))

    return docs.mapInArrow(run, schema)
