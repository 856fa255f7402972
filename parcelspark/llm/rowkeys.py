"""One long key for each distinct (identifier, text) of a table of documents.

A document whose identifier no other row has keeps it as its key. Rows with a null
or repeated identifier, or one of at least 2**62 in size, get a key above all
others from a 62-bit hash of identifier and text, so that different texts under
one identifier stay apart and lose against plain identifiers. Rows equal in
identifier and text share a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.scratch import drop, stash

HIGH = 1 << 62
#: Rows of a narrow table that are broadcast at most, once they are counted.
MAX_BROADCAST = 1_000_000


def side(narrow: DataFrame, rows: int | None = None) -> DataFrame:
    """The narrow side of a join: broadcast where its count is below the bound, else as Spark plans it."""
    n = narrow.count() if rows is None else rows
    return F.broadcast(narrow) if n <= MAX_BROADCAST else narrow


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = "key") -> DataFrame:
    """docs with a column `key`; the texts move only where more than MAX_BROADCAST identifiers are repeated."""
    doc_id = F.col(id_col).cast("long")
    own = F.xxhash64(doc_id, F.col(text_col)).bitwiseAND(F.lit(HIGH - 1)) + F.lit(HIGH)
    odd = doc_id.isNull() | (doc_id >= HIGH) | (doc_id <= -HIGH)
    again = docs.select(doc_id.alias("id")).where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = stash(again.select(F.col("id").alias(f"{key}_again")), "repeated-ids")
    n = again.count()
    if not n:
        drop(again)
        return docs.withColumn(key, F.when(odd, own).otherwise(doc_id))
    out = docs.join(side(again, n), doc_id == F.col(f"{key}_again"), "left")
    return out.withColumn(key, F.when(odd | F.col(f"{key}_again").isNotNull(), own).otherwise(doc_id)).drop(f"{key}_again")
