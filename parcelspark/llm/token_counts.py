"""Edit-aware token counts.

A document is a segment tree over leaves of whole pre-tokens. Nodes hold the
characters and tokens below them. An edit finds its leaves by character sums,
re-encodes those leaves only (with neighbours while a boundary is not one that
pre-tokens respect: the boundary context), and updates the sums on the path to
the root.

The trees are a table: `build_trees` encodes every text once and keeps a row per
document with the leaves and the sums of all nodes in heap order; `apply_edits` reads
that table, so a document that is edited again is not encoded anew, and can return
the edited trees, to be written as the next version of the table.

Defined cases: null and empty texts have no tokens; an edit is cut to the text it
applies to; rows with equal identifiers are counted each on their own; a null
edit list is empty. Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelspark.scratch import prepare, stash
from parcelspark.llm.tokens import Encoder, encoder

SCHEMA = "doc_id long, n_tokens long, edited_tokens long, n_edits long, edited_chars long, reencoded_chars long"
TREE = "doc_id long, leaves array<string>, tokens array<int>, chars array<int>"
EDITS = "array<struct<start:long,stop:long,new:string>>"


class TokenTree:
    """Counts of one text under edits; leaf_pieces pre-token pieces make a leaf at first."""

    def __init__(self, text: str, enc: Encoder, leaf_pieces: int = 16):
        self.enc = enc
        parts, counts = enc.pieces(text)
        starts = range(0, len(parts), leaf_pieces)
        self.leaves = [(" " if i else "") + " ".join(parts[i : i + leaf_pieces]) for i in starts]
        sums = np.add.reduceat(counts, starts).tolist() if parts else []
        if not self.leaves:
            self.leaves, sums = [""], [0]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.leaves += [""] * (self.size - len(self.leaves))
        self.tokens = [0] * self.size + sums + [0] * (self.size - len(sums))
        self.chars = [0] * self.size + [len(x) for x in self.leaves]
        for i in range(self.size - 1, 0, -1):
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.reencoded = 0

    @classmethod
    def of(cls, enc: Encoder, leaves: list[str], tokens: list[int], chars: list[int]) -> "TokenTree":
        """A tree as it was kept; nothing is encoded."""
        tree = cls.__new__(cls)
        tree.enc, tree.leaves, tree.tokens, tree.chars, tree.size, tree.reencoded = enc, leaves, tokens, chars, len(leaves), 0
        return tree

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, at: int) -> tuple[int, int]:
        """Leaf that holds the character at `at`, and the offset of the leaf's first character."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if at - before >= self.chars[i] and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        return i - self.size, before

    def _set(self, leaf: int, text: str, count: bool) -> None:
        self.leaves[leaf] = text
        i = leaf + self.size
        if count:
            self.reencoded += len(text)
        self.chars[i], self.tokens[i] = len(text), self.enc.count(text) if count else 0
        while i > 1:
            i //= 2
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    def _filled(self, leaf: int, step: int) -> int | None:
        """Next leaf with text in a direction, found through the sums."""
        i = leaf + self.size
        while i > 1:
            sibling = i ^ 1
            if (sibling > i) == (step > 0) and self.chars[sibling]:
                i = sibling
                while i < self.size:
                    i = 2 * i + (step < 0)
                    if not self.chars[i]:
                        i ^= 1
                return i - self.size
            i //= 2
        return None

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replaces characters start to stop by new."""
        n = self.chars[1]
        start = min(max(start, 0), n)
        stop = min(max(stop, start), n)
        first, before = self._find(start)
        last, at_last = self._find(max(start, stop - 1))
        tail = self.leaves[last][stop - at_last :]
        text = self.leaves[first][: start - before] + new + tail
        i = first
        while i is not None and i < last:
            i = self._filled(i, 1)
            if i is not None and i <= last:
                self._set(i, "", False)
        # the boundary context: whole neighbours come in until both ends are boundaries of pre-tokens
        while (p := self._filled(first, -1)) is not None and not _boundary(self.leaves[p], text):
            text = self.leaves[p] + text
            self._set(p, "", False)
        while (p := self._filled(first, 1)) is not None and not _boundary(text, self.leaves[p]):
            text += self.leaves[p]
            self._set(p, "", False)
        self._set(first, text, True)


def _boundary(left: str, right: str) -> bool:
    return len(right) > 1 and right[0] == " " and not right[1].isspace() and left != "" and not left[-1].isspace()


def build_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", keep: tuple[str, ...] = ()) -> DataFrame:
    """The tree of each whole text (see TREE), and the columns of docs named in keep."""
    prepare(docs.sparkSession)
    fields = [docs.schema[k] for k in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                trees = [TokenTree(t or "", enc) for t in part.column(1).to_pylist()]
                yield _tree_batch(part.column(0), trees, part.columns[2:], keep)

    schema = T.StructType([*T.StructType.fromDDL(TREE).fields, *fields])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keep).mapInArrow(run, schema)


def _tree_batch(ids: pa.Array, trees: list[TokenTree], more: list[pa.Array], names: tuple[str, ...]) -> pa.RecordBatch:
    lists = [pa.array([t.leaves for t in trees], pa.list_(pa.string())), pa.array([t.tokens for t in trees], pa.list_(pa.int32())), pa.array([t.chars for t in trees], pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays([ids, *lists, *more], ["doc_id", "leaves", "tokens", "chars", *names])


def apply_edits(trees: DataFrame, edits: Column, tokenizer: str = "byte_bpe_50k.json", new_trees: bool = False) -> DataFrame:
    """Counts before and after the edits (array<struct<start, stop, new>>, applied in order; see SCHEMA), or the edited trees."""
    prepare(trees.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            for i in range(0, b.num_rows, 64):
                rows, done, part = [], [], b.slice(i, 64)
                for doc_id, leaves, tokens, chars, changes in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    tree = TokenTree.of(enc, leaves, tokens, chars)
                    before, touched = tree.total, 0
                    for c in changes or ():
                        tree.edit(c["start"] or 0, c["stop"] or 0, c["new"] or "")
                        touched += len(c["new"] or "")
                    rows.append((doc_id, before, tree.total, len(changes or ()), touched, tree.reencoded))
                    done.append(tree)
                if new_trees:
                    yield _tree_batch(part.column(0), done, [], ())
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return trees.select("doc_id", "leaves", "tokens", "chars", edits.cast(EDITS).alias("edits")).mapInArrow(run, TREE if new_trees else SCHEMA)


def token_counts(docs: DataFrame, edits: Column | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Tokens of each whole text, and after its edits, by a written table of trees."""
    edits = F.lit(None) if edits is None else edits
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), edits.cast(EDITS).alias("edits"))
    return apply_edits(stash(build_trees(own, tokenizer=tokenizer, keep=("edits",)), "token-trees"), F.col("edits"), tokenizer)


def revision(text: Column) -> Column:
    """The edits of the query: a replacement, an insertion and a deletion at the quarters of each text."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    one = lambda at, stop, new: F.struct(at.cast("long").alias("start"), stop.cast("long").alias("stop"), F.lit(new).alias("new"))
    q = lambda k: F.floor(n * k / 4)
    return F.array(one(q(3), q(3) + 12, "[edited]"), one(q(2), q(2), " inserted words, "), one(q(1), q(1) + 24, ""))
