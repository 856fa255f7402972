"""Mixing sources to target weights by temperature.

Token shares are raised to an exponent and normalised. The exponent is bisected
to reach a target entropy; where that would repeat a source more often than the
limit, it is bisected towards 1 until no source exceeds it. A source's share of
the token budget is realised as whole epochs plus a part: its documents lie in
blocks by hash, each epoch permutes the blocks, and the last epoch takes blocks
in that order while they fit, then documents of the next block in hash order.

Tokens are those of a public tokenizer, counted once into a narrow table of
identifier, source and tokens. The plan has one row per source, epoch and block
(blocks per source is a parameter), so documents are decided by a join with a table
of checked size and no text moves.

Defined cases: null source is a source of its own (the empty name); null and
empty texts have no tokens and come with every whole epoch and no part of one;
a source without tokens has weight 0 and no copies; equal rows are decided alike,
and rows with null or repeated identifiers by identifier and text; an empty table
gives an empty result. Other columns are kept by `mix` and ignored by `mixing_plan`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.llm.rowkeys import side
from parcelspark.llm.tokens import encoder
from parcelspark.scratch import prepare, stash

#: The exponent is found on the driver from one number per source; more sources than this are refused.
MAX_SOURCES = 100_000


def entropy(q: np.ndarray) -> float:
    q = q[q > 0]
    return float(-(q * np.log(q)).sum())


def tempered(tokens: np.ndarray, exponent: float) -> np.ndarray:
    """Normalised weights; sources without tokens have none."""
    p = tokens / max(tokens.sum(), 1)
    q = np.where(tokens > 0, np.power(np.where(tokens > 0, p, 1.0), exponent), 0.0)
    return q / max(q.sum(), 1e-300)


def bisect(good_at_one, steps: int = 60) -> float:
    """Smallest exponent in [0, 1] that is good, where 1 is and what is good stays so above."""
    if good_at_one(0.0):
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if good_at_one(mid) else (mid, hi)
    return hi


#: Leading bits of a document's order by which a block is summed first.
LEAD_BITS = 12


def choose_exponent(tokens: np.ndarray, target_entropy: float | None, max_repeats: float | None, budget: float) -> float:
    """Exponent that meets the entropy (no more than it), unless a source would repeat more than the limit."""
    if not tokens.sum():
        return 1.0
    a = 1.0 if target_entropy is None else bisect(lambda x: entropy(tempered(tokens, x)) <= target_entropy)
    if max_repeats is not None:
        worst = lambda x: float((budget * tempered(tokens, x)[tokens > 0] / tokens[tokens > 0]).max())
        if worst(1.0) > max_repeats:
            return 1.0  # the budget itself is above the limit: the natural mix repeats least
        a = max(a, bisect(lambda x: worst(x) <= max_repeats))
    return a


def _placed(docs: DataFrame, blocks: int, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """docs with source, block and order of each document, by hashes of identifier and text. Columns begin with __mix_, so that they meet none of the input."""
    h = lambda k: F.xxhash64(F.col(id_col).cast("long"), F.col(text_col), F.lit(seed + k))
    return docs.withColumns({"__mix_source": F.coalesce(F.col(source_col).cast("string"), F.lit("")), "__mix_block": F.pmod(h(0), F.lit(blocks)).cast("int"), "__mix_order": h(1)})


def token_table(placed: DataFrame, id_col: str, text_col: str, tokenizer: str) -> DataFrame:
    """doc_id, source, block, order and tokens of every whole text."""
    prepare(placed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            n = [enc.count(t) if t else 0 for t in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(n, pa.int64())], ["doc_id", "source", "block", "order", "tokens"])

    own = placed.select(F.col(id_col).cast("long").alias("doc_id"), "__mix_source", "__mix_block", "__mix_order", F.col(text_col).alias("text"))
    return own.mapInArrow(run, "doc_id long, source string, block int, order long, tokens long")


def make_plan(tokens: DataFrame, target_entropy: float | None, max_repeats: float | None, budget_share: float, seed: int) -> tuple[DataFrame, float]:
    """For each source and block: epochs that take it, its place in the permutation of each, the order up to which one more takes documents, the weight; and the exponent."""
    spark = tokens.sparkSession
    sums = stash(tokens.groupBy("source", "block").agg(F.sum("tokens").alias("t")), "mix-blocks")
    per = sums.groupBy("source").agg(F.sum("t").alias("t"))
    if (n := per.count()) > MAX_SOURCES:
        raise ValueError(f"{n} sources; at most {MAX_SOURCES} are mixed")
    totals = per.orderBy("source").toPandas()  # one row per source, counted just now
    t = totals["t"].to_numpy(float)
    budget = budget_share * t.sum()
    goal = None if target_entropy is None else target_entropy * np.log(max((t > 0).sum(), 1))
    exponent = choose_exponent(t, goal, max_repeats, budget)
    q = tempered(t, exponent) if len(t) else t
    with np.errstate(divide="ignore", invalid="ignore"):
        epochs = np.where(t > 0, np.floor(budget * q / np.maximum(t, 1) + 1e-9), 0)
    rest = np.maximum(budget * q - epochs * t, 0)
    shares = spark.createDataFrame([(s, float(w), int(e), float(r)) for s, w, e, r in zip(totals["source"], q, epochs, rest, strict=True)], "source string, weight double, epochs int, rest double")
    # each epoch, the last one in part, is a permutation of the source's blocks
    laid = sums.join(side(shares, n), "source").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs"))))
    w = Window.partitionBy("source", "epoch").orderBy(F.xxhash64("source", "epoch", "block", F.lit(seed)), "block")
    laid = laid.withColumns({"place": F.row_number().over(w) - 1, "upto": F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    laid = stash(laid.withColumn("whole", (F.col("epoch") < F.col("epochs")) | (F.col("upto") <= F.col("rest"))), "mix-epochs")
    cut = laid.where("NOT whole AND upto - t < rest").select("source", "block", "place", (F.col("rest") - F.col("upto") + F.col("t")).alias("room"))
    # one block of each source is taken in part. Sums by leading bits of its order find the bits where the room ends;
    # only documents with these are summed one by one, a millionth of the source
    inside = tokens.select("source", "block", "order", "tokens").where("tokens > 0").join(side(cut, n), ["source", "block"])
    inside = inside.withColumn("lead", F.shiftright("order", 64 - LEAD_BITS))
    so_far = Window.partitionBy("source", "block").orderBy("lead").rowsBetween(Window.unboundedPreceding, 0)
    bits = inside.groupBy("source", "block", "lead").agg(F.sum("tokens").alias("t"), F.max("order").alias("top"), F.first("room").alias("room"), F.first("place").alias("place"))
    bits = stash(bits.withColumn("sum", F.sum("t").over(so_far)), "mix-bits")
    edge = bits.where("sum > room AND sum - t < room").select("source", "block", "lead", (F.col("sum") - F.col("t")).alias("before"))
    one = inside.join(side(edge, n), ["source", "block", "lead"])
    one = one.withColumn("sum", F.col("before") + F.sum("tokens").over(Window.partitionBy("source", "block").orderBy("order").rangeBetween(Window.unboundedPreceding, 0)))
    ends = bits.where("sum <= room").select("source", "block", F.col("top").alias("order"), "place").unionByName(one.where("sum <= room").select("source", "block", "order", "place"))
    last = ends.groupBy("source", "block").agg(F.max("order").alias("last"), F.first("place").alias("last_place"))
    whole = laid.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.when(F.col("whole"), F.struct("epoch", "place")))).alias("places"), F.first("weight").alias("weight"))
    return whole.join(last, ["source", "block"], "left"), exponent


def _decided(rows: DataFrame, plan: DataFrame, some: Column) -> DataFrame:
    """rows (with source, block, order) and `copies`, `epoch_places`, `weight`; some: whether a document has tokens."""
    names = {"source": "__plan_source", "block": "__plan_block", "places": "__plan_places", "weight": "__plan_weight", "last": "__plan_last", "last_place": "__plan_last_place"}
    plan = stash(plan.withColumnsRenamed(names), "mix-plan")
    out = rows.join(side(plan), F.expr("__mix_source = __plan_source AND __mix_block = __plan_block"), "left")
    extra = F.coalesce((F.col("__mix_order") <= F.col("__plan_last")) & some, F.lit(False))
    places = F.coalesce(F.transform("__plan_places", lambda x: x["place"]), F.array().cast("array<int>"))
    places = F.when(extra, F.concat(places, F.array("__plan_last_place"))).otherwise(places)
    return out.withColumn("__mix_places", places)


def mixing_plan(docs: DataFrame, target_entropy: float | None = 0.98, max_repeats: float | None = 4.0, budget_share: float = 1.0, blocks: int = 1024, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, source, n_tokens, weight of the source, exponent, copies of the document, its block, and the place of the block in the permutation of each epoch that takes the document.

    target_entropy: share of the largest.
    """
    tokens = stash(token_table(_placed(docs, blocks, seed, id_col, text_col, source_col), id_col, text_col, tokenizer), "mix-tokens")
    plan, exponent = make_plan(tokens, target_entropy, max_repeats, budget_share, seed)
    out = _decided(tokens.withColumnsRenamed({"source": "__mix_source", "block": "__mix_block", "order": "__mix_order"}), plan, F.col("tokens") > 0)
    return out.select("doc_id", F.col("__mix_source").alias("source"), F.col("tokens").alias("n_tokens"), F.coalesce("__plan_weight", F.lit(0.0)).alias("weight"), F.lit(exponent).alias("exponent"), F.size("__mix_places").cast("long").alias("copies"), F.col("__mix_block").alias("block"), F.col("__mix_places").alias("epoch_places"))


def mix(docs: DataFrame, target_entropy: float | None = 0.98, max_repeats: float | None = 4.0, budget_share: float = 1.0, blocks: int = 1024, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """The rows of docs, all columns, as often as the mix takes them."""
    placed = _placed(docs, blocks, seed, id_col, text_col, source_col)
    tokens = stash(token_table(placed, id_col, text_col, tokenizer), "mix-tokens")
    plan, _ = make_plan(tokens, target_entropy, max_repeats, budget_share, seed)
    # every text that is not empty has a token
    out = _decided(placed, plan, F.coalesce(F.length(F.col(text_col)), F.lit(0)) > 0)
    return out.withColumn("__mix_copy", F.explode("__mix_places")).select(*docs.columns)
