"""Prefix trie of conversations by smallest-member ownership.

A node is a distinct sequence of first turns; its members are the conversations
that begin with it, and the smallest member owns it. A conversation owns a suffix
of its own path, since it stays the smallest member of whatever lies below. So each
subtree is a set of members, and sums over subtrees need no walk of the tree: what
a member adds to a node is all that its path holds from there on, less what it owns
there. Windows along each conversation mark owned nodes and make those sums from
the end of the path; one group-by on the prefix then adds the members up.

Nothing depends on how common a prefix or how long a conversation is:

* turns are numbered by a range partitioning on (conversation, turn) and the counts
  of the parts before, so a conversation may span many tasks;
* a prefix is known by the exclusive or of hashes of (turn, depth), 128 bits, which
  windows make in blocks of depths and the blocks' totals carry on (of 10**12 nodes
  two differ under one key with a chance of 0.000000000000002);
* owners and members come from pre-aggregated sums, never from a window over a node;
* identifiers that end at a node are range partitioned, joined to chunks where they
  lie, and only chunks go to the node's digest, which is hashed as a stream.

Defined cases: null role and text are empty; a null turn comes first; turns of one
number follow each other by the digest of role and text; repeated rows are turns
each; rows without a conversation are left out; an empty table has no nodes. Other
input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.scratch import prepare, stash

#: Depths that one window holds.
BLOCK = 4096
#: Bytes of a chunk of identifiers.
CHUNK = 256 << 10
KEY = ["depth", "k1", "k2"]


def numbered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, i (place from 0), digest of role and text, tokens (bytes of the text) of every turn."""
    r, t = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256))
    rows = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(t).cast("long").alias("tokens"))
    placed = stash(rows.repartitionByRange("conv_id", "turn", "digest").withColumn("part", F.spark_partition_id()), "turns")
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # bounded: in each part only its first conversation can have begun in an earlier one
    begun = placed.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before).where("before > 0").drop("n")
    local = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "digest")) - 1
    out = placed.withColumn("i", local.cast("long")).join(F.broadcast(begun), ["conv_id", "part"], "left")
    return out.select("conv_id", (F.col("i") + F.coalesce("before", F.lit(0))).alias("i"), "digest", "tokens")


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their family.

    Of conversation c the first h = crc32(c) % most turns are those of c - c % family, as far as they go.
    Gives members (conv_id, length) and turns (conv_id, depth from 1, length, digest, tokens).
    """
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    head = own.select(F.col("conv_id").alias("first"), F.col("n").alias("there"))
    h = F.crc32(F.col("conv_id").cast("string")) % most
    known = own.withColumns({"h": h, "first": F.col("conv_id") - F.col("conv_id") % family}).join(head, "first", "left")
    known = known.withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    length = F.when(F.col("conv_id") == F.col("first"), F.col("n")).otherwise(F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    known = known.select("conv_id", "first", "h", "taken", length.alias("length"))
    same = F.col("conv_id") == F.col("first")
    # a conversation may hold a third of all turns; its rows are narrow, and adaptive execution splits them
    rest = turns.join(known, "conv_id").where(same | (F.col("i") >= F.col("h")))
    rest = rest.select("conv_id", F.when(same, F.col("i") + 1).otherwise(F.col("i") - F.col("h") + F.col("taken") + 1).alias("depth"), "length", "digest", "tokens")
    heads = turns.where((F.col("i") < most - 1) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "first")
    lent = heads.join(known.where(~same), "first").where(F.col("i") < F.col("h"))
    lent = lent.select("conv_id", (F.col("i") + 1).alias("depth"), "length", "digest", "tokens")
    return known.select("conv_id", "length"), rest.unionByName(lent)


def _lane(seed: int) -> Column:
    return F.when(F.col("depth") > 0, F.xxhash64(F.lit(seed), "digest", "depth")).otherwise(F.lit(0).cast("long"))


def occurrences(members: DataFrame, turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation and depth, from 0: key of the prefix (k1, k2) and of that without the last turn (p1, p2)."""
    roots = members.select("conv_id", F.lit(0).cast("long").alias("depth"), "length", F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("tokens"))
    rows = turns.unionByName(roots).withColumn("block", F.floor(F.col("depth") / block))
    rows = rows.withColumns({"h1": _lane(1), "h2": _lane(2)}).drop("digest")
    path = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    total = rows.where(F.col("length") >= block).groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    total = total.select("conv_id", "block", *(F.bit_xor(f"h{i}").over(path).alias(f"b{i}") for i in (1, 2)))
    so_far = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(total, ["conv_id", "block"], "left")
    keys = {f"k{i}": F.bit_xor(f"h{i}").over(so_far).bitwiseXOR(F.coalesce(f"b{i}", F.lit(0).cast("long"))) for i in (1, 2)}
    out = out.withColumns(keys).withColumns({f"p{i}": F.col(f"k{i}").bitwiseXOR(F.col(f"h{i}")) for i in (1, 2)})
    return out.select("conv_id", "depth", "block", "length", "tokens", "k1", "k2", "p1", "p2")


def marked(occ: DataFrame, owners: DataFrame, block: int = BLOCK) -> DataFrame:
    """occ with what the conversation adds to the node: saved tokens and leaves from there on, and whether it owns the next one."""
    own = owners.select(F.col("owner").alias("conv_id"), "depth", (F.col("deepest") == F.col("depth")).alias("leaf"))
    # both sides are unique by (conversation, depth)
    rows = occ.join(own, ["conv_id", "depth"], "left").withColumn("owned", F.col("leaf").isNotNull().cast("long"))
    rows = rows.withColumns({"leaf": F.coalesce(F.col("leaf").cast("long"), F.lit(0)), "saved": F.when(F.col("owned") == 0, F.col("tokens")).otherwise(0)})
    later = Window.partitionBy("conv_id").orderBy(F.desc("block"))
    sums = rows.where(F.col("length") >= block).groupBy("conv_id", "block")
    sums = sums.agg(F.sum("saved").alias("s"), F.sum("leaf").alias("l"), F.max(F.when(F.col("depth") % block == 0, F.col("owned"))).alias("o"))
    after = later.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "block", F.sum("s").over(after).alias("s"), F.sum("l").over(after).alias("l"), F.lag("o").over(later).alias("o"))
    back = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth"))
    onwards, zero = back.rowsBetween(Window.unboundedPreceding, 0), F.lit(0)
    out = rows.join(sums, ["conv_id", "block"], "left")
    return out.select(
        "conv_id",
        *KEY,
        (F.sum("saved").over(onwards) + F.coalesce("s", zero)).alias("saved"),
        (F.sum("leaf").over(onwards) + F.coalesce("l", zero)).alias("leaves"),
        F.coalesce(F.lag("owned").over(back), "o", zero).alias("next"),
    )


def end_digests(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """SHA-256 of the comma-joined identifiers of each key, ascending, for rows (depth, k1, k2, conv_id)."""
    prepare(ends.sparkSession)
    schema = "depth long, k1 long, k2 long, conv_id long, ids string"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of identifiers of one key, as they follow each other in this task."""
        now, first, held, size = None, None, [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (*now, first)), pa.array([",".join(held)])], ["depth", "k1", "k2", "conv_id", "ids"])

        out, out_size = [], 0
        for b in batches:
            for *key, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != now or size > chunk:
                    if held:
                        out.append(row())
                        out_size += size
                    now, first, held, size = key, conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
            if out_size > 4 * chunk or len(out) > 4096:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
                out, out_size = [], 0
        if held:
            out.append(row())
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One digest per key; its chunks follow each other, so only the state is held."""
        names = [*KEY, "ends_sha256"]
        now, state, rows = None, None, []

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3])], names)

        for b in batches:
            for *key, ids in zip(*(b.column(c).to_pylist() for c in (0, 1, 2, 4)), strict=True):
                if key != now:
                    if state is not None:
                        rows.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if len(rows) > 4096:
                yield out()
        if state is not None:
            rows.append((*now, state.hexdigest()))
        if rows:
            yield out()

    chunks = ends.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(join, schema)
    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "conv_id").mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(members: DataFrame, turns: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """One row per node of the trie of conversations (members: conv_id, length; turns: conv_id, depth, length, digest, tokens).

    A node's own turn is turn `depth` of conversation `conv_id`.
    """
    occ = stash(occurrences(members, turns, block), "trie-occurrences")
    owners = stash(occ.groupBy(*KEY).agg(F.min("conv_id").alias("owner"), F.max("length").alias("deepest"), F.min("p1").alias("p1"), F.min("p2").alias("p2")), "trie-owners")
    added = marked(occ, owners, block).groupBy(*KEY)
    nodes = added.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("next").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    # where an owner's path leaves that of a smaller conversation: one row per owner
    leaves = owners.groupBy("owner").agg(F.min(F.struct("depth", "p1", "p2")).alias("x")).where("x.depth > 0")
    leaves = leaves.select(F.col("owner").alias("conv_id"), "x.depth", F.col("x.p1").alias("k1"), F.col("x.p2").alias("k2"), (F.col("x.depth") - 1).alias("up"))
    above = owners.select(F.col("depth").alias("up"), "k1", "k2", F.col("owner").alias("parent"))
    leaves = leaves.join(above, ["up", "k1", "k2"]).select("conv_id", "depth", "parent")
    ends = end_digests(occ.where("depth = length"), chunk)
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))
    out = nodes.join(ends, KEY, "left").join(leaves, ["conv_id", "depth"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """The trie of the conversations as `rebuilt` makes them from the rows of the table."""
    turns = stash(numbered(conversations), "numbered-turns")
    return prefix_trie(*rebuilt(turns, family, most))


SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
    sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS g, turn
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, g, strlen(x) AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) - 1 AS i FROM t),
c AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS b,
    xor(list_reduce(
      list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, strlen(CAST(conv_id AS VARCHAR)) + 1), lambda j: CAST(ascii(substr(CAST(conv_id AS VARCHAR), j, 1)) AS BIGINT))),
      lambda a, z: list_reduce(list_concat([xor(a, z)], range(8)), lambda y, k: xor(y >> 1, CAST(3988292384 AS BIGINT) * (y & 1)))
    ), CAST(4294967295 AS BIGINT)) % 9 AS h
  FROM o),
s AS (
  SELECT c.conv_id, 0 AS part, o.i, o.g, o.w FROM c JOIN o ON o.conv_id = c.b WHERE o.i < c.h
  UNION ALL SELECT c.conv_id, 1, o.i, o.g, o.w FROM c JOIN o ON o.conv_id = c.conv_id WHERE o.i >= c.h),
d AS (SELECT conv_id, g, w, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS depth FROM s),
p AS (
  SELECT conv_id, depth, w, string_agg(g, ',') OVER (PARTITION BY conv_id ORDER BY depth) AS k,
    coalesce(string_agg(g, ',') OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS up,
    count(*) OVER (PARTITION BY conv_id) AS len
  FROM d
  UNION ALL SELECT c.conv_id, 0, 0, '', NULL, (SELECT count(*) FROM d WHERE d.conv_id = c.conv_id) FROM c),
n AS (
  SELECT k, any_value(up) AS up, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS saved,
    CAST(max(len) = any_value(depth) AS BIGINT) AS leaf, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len = depth), '') AS ends
  FROM p GROUP BY k),
u AS (SELECT p.k, sum(n.saved) AS saved, sum(n.leaf) AS leaves FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.k),
f AS (SELECT up AS k, count(*) AS n FROM n WHERE up IS NOT NULL GROUP BY up)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, a.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(f.n, 0) AS BIGINT) AS n_children,
  CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN u USING (k) LEFT JOIN f USING (k) LEFT JOIN n a ON n.up = a.k
"""
