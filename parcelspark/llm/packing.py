"""Sum-of-squares online packing of tokenised documents into fixed windows.

Every task packs its own stream of documents. A document of at least one whole
window fills windows of its own; what is left goes to the fill level that makes
the sum of squared counts of partially filled windows smallest. Counts by level
are one array. At the end of a task (or when too many windows are open) the
windows still open are joined end to end and cut into whole windows; the last
rest is cut at powers of two, which need no padding. So no window is padded and
only documents of that last step are cut at odd places.

Defined cases: null and empty texts have one token, the end token; repeated rows
are packed as often as they occur; an empty table gives no rows. Other input
columns are ignored. Task output depends only on the order of its input rows, and
sequence ids are task number and running number, so a repeated task agrees with
itself over file scans.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.scratch import prepare
from parcelspark.llm.tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Piece:
    """A run of one document's ids; data holds them as little-endian 32-bit integers."""

    __slots__ = ("doc_id", "start", "data", "total")

    def __init__(self, doc_id: int | None, start: int, data: bytes, total: int):
        self.doc_id, self.start, self.data, self.total = doc_id, start, data, total

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        return Piece(self.doc_id, self.start, self.data[: 4 * n], self.total), Piece(self.doc_id, self.start + n, self.data[4 * n :], self.total)


class SumOfSquares:
    """add(pieces of a document) and close(); emit(sequence) receives the finished lists of pieces."""

    def __init__(self, width: int, emit: Callable[[list[Piece]], None], max_open: int = 4096):
        self.width, self.emit, self.max_open = width, emit, max_open
        self.count = np.zeros(width + 1, np.int64)  # open windows by fill level; both ends stay 0
        self.open: dict[int, list[list[Piece]]] = {}
        self.n_open = 0

    def add(self, piece: Piece) -> None:
        while len(piece.data) >= 4 * self.width:
            head, piece = piece.cut(self.width)
            self.emit([head])
        s = len(piece.data) >> 2
        if not s:
            return
        level = self.choose(s)
        if level:
            window = self.open[level].pop()
            self.count[level] -= 1
            self.n_open -= 1
        else:
            window = []
        window.append(piece)
        if level + s == self.width:
            self.emit(window)
            return
        self.open.setdefault(level + s, []).append(window)
        self.count[level + s] += 1
        self.n_open += 1
        if self.n_open > self.max_open:
            self.close()

    def choose(self, s: int) -> int:
        """The level (0: a new window) whose use makes the sum of squares smallest; of equals the fullest."""
        n, w = self.count, self.width
        change = 2 * n[s : w + 1]
        change[-1] = -1  # a full window leaves the sum
        change[1:] += 2 - 2 * n[1 : w - s + 1]
        change[0] += 1 if s < w else 0
        change[1:][n[1 : w - s + 1] == 0] = 1 << 60
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def close(self) -> None:
        """Joins the open windows, fullest first, and cuts them into whole ones and powers of two."""
        stream = [p for level in sorted(self.open, reverse=True) for window in self.open[level] for p in window]
        left = sum(len(p.data) >> 2 for p in stream)
        room, now = 0, []
        for p in stream:
            while p is not None:
                if not room:
                    room = self.width if left >= self.width else 1 << (left.bit_length() - 1)
                head, rest = p.cut(room) if len(p.data) > 4 * room else (p, None)
                now.append(head)
                took = len(head.data) >> 2
                room, left = room - took, left - took
                if not room:
                    self.emit(now)
                    now = []
                p = rest
        self.open.clear()
        self.count[:] = 0
        self.n_open = 0


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2048, end_id: int = 1, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """One row per piece of a document in a sequence of at most `width` tokens."""
    prepare(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        base, rows, sequences = TaskContext.get().partitionId() << 40, [], [0]

        def emit(window: list[Piece]) -> None:
            at, sid = 0, base + sequences[0]
            sequences[0] += 1
            for p in window:
                n = len(p.data) >> 2
                rows.append((p.doc_id, p.start, n, zlib.crc32(p.data), p.total, sid, at))
                at += n

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        packer = SumOfSquares(width, emit)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = enc.ids(text or "").tobytes() + end
                packer.add(Piece(doc_id, 0, data, len(data) >> 2))
            if len(rows) >= 4096:
                yield out()
        packer.close()
        if rows:
            yield out()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
