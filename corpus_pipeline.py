"""The corpus pipeline: toxicity, exact dedup, near-duplicate join, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every
stage's rows as Parquet in the shared folder and rereads them as the next one's
docs. All stages but the last return the columns of documents, and further columns
of docs, whatever their names. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from parcelspark.scratch import stash


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the non-held-out labels.

    Null and empty texts have the score of a text without terms; rows are judged each
    by its own text, whatever their identifiers; without positive labels all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.train(docs, labels, ~toxicity.held_out(F.col("doc_id"))))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised text one with the smallest identifier.

    Null texts are empty texts; null identifiers lose; of repeated rows one stays; of
    different texts under one identifier only those that are copies go.
    """
    return exact_dedup.one_of_each(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest identifier, of each group joined by links.

    Texts without words are one group; null and repeated identifiers take part by a key
    of identifier and text and lose against others; of repeated rows one stays.
    """
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: near-even sources, none repeated more than four times.

    Null sources are one source; texts without tokens come with every whole epoch;
    repeated rows are taken alike.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens; null and empty texts have the end token, repeated rows come each."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: Classifier training, MinHash and tokenisation have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
