"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary
(letters only, lower case; a space marks the beginning of a word). A word's
probability is the sum over all its segmentations into pieces, by the forward
algorithm; single bytes outside the vocabulary have a small fixed probability. All
letter pieces of the vocabulary count, of any length.
Probabilities come from expectation maximisation over the same lattices on a
bounded sample: `per_lang` documents of each language in hash order, whole texts
(words beyond 96 bytes are learned from in parts, cut between characters). The words
of the sample reach the driver. A text's score is the posterior of its best language under a uniform prior.

Defined cases: null texts and texts without a letter are `und` with score 0;
equal posteriors go to the language first in alphabetical order; without any
training document every text is `und`; null languages are not learned from; more
than MAX_LANGS languages are refused; an empty table gives an empty result. Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.llm import textkit as K
from parcelspark.scratch import prepare, stash

SCHEMA = "doc_id long, lang_pred string, score double"
#: The probability of a byte that no piece covers, and the bytes of a word that are learned from at once.
BYTE_FLOOR, MAX_LEARNED = 1e-8, 96
#: Pieces beyond this length are looked for only where a word's last bytes are those of one.
SHORT_PIECE, TAIL = 12, 8
MAX_LANGS = 5000


def vocabulary(tokenizer: str = "piece_bpe_32k.model") -> list[bytes]:
    """Lower-case letter pieces of the vocabulary, with a space where a word begins."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokenizer))
    out = set()
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if piece.removeprefix("▁").isalpha() or piece == "▁":
            out.add(piece.lower().replace("▁", " ").encode())
    return sorted(out)


class PieceTable:
    """Piece numbers of byte ranges, by hash: one direct table and the few pieces that share its slots."""

    def __init__(self, pieces: list[bytes]):
        buf = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        self.keys = K.RangeHash(buf)(ends - [len(p) for p in pieces], ends)
        slot = (self.keys >> K.U(42)).astype(np.int64)
        self.slots = np.full(1 << 22, -1, np.int32)
        self.slots[slot] = np.arange(len(pieces))
        lost = self.slots[slot] != np.arange(len(pieces))
        self.more = {int(h): i for i, h in zip(np.flatnonzero(lost), self.keys[lost], strict=True)}
        self.crowded = np.zeros(1 << 22, bool)
        self.crowded[slot[lost]] = True
        size = np.array([len(p) for p in pieces])
        self.lengths = sorted(set(size.tolist()))
        self.tails = np.zeros(1 << 16, bool)
        far = size > SHORT_PIECE
        self.tails[K.RangeHash(buf)(ends[far] - TAIL, ends[far]) >> K.U(48)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        slot = (h >> K.U(42)).astype(np.int64)
        at = self.slots[slot]
        hit = at >= 0
        hit[hit] = self.keys[at[hit]] == h[hit]
        out = np.where(hit, at, -1)
        for i in np.flatnonzero(self.crowded[slot] & ~hit):
            out[i] = self.more.get(int(h[i]), -1)
        return out


class Lattice:
    """Pieces that end at each position of some words, longest words first.

    words: bytes with a leading space each, end to end.
    """

    def __init__(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, table: PieceTable):
        self.order = np.argsort(start - end, kind="stable")
        self.start, self.length = start[self.order], (end - start)[self.order]
        self.longest = int(self.length[0]) if len(self.length) else 0
        self.active = np.searchsorted(-self.length, -np.arange(self.longest + 1), "right")
        rh = K.RangeHash(buf)
        #: position -> piece length, word numbers and piece numbers
        self.arcs: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(self.longest + 1)]
        for p in range(1, self.longest + 1):
            s = self.start[: self.active[p]]
            far = None
            for k in table.lengths:
                if k > p:
                    break
                if k > SHORT_PIECE and far is None:
                    far = np.flatnonzero(table.tails[rh(s + (p - TAIL), s + p) >> K.U(48)])
                own = s if k <= SHORT_PIECE else s[far]
                if not len(own):
                    break
                at = table.find(rh(own + (p - k), own + p))
                w = np.flatnonzero(at >= 0)
                if len(w):
                    self.arcs[p].append((k, w if k <= SHORT_PIECE else far[w], at[w]))
        self.depth = max((k for x in self.arcs for k, _, _ in x), default=1)

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """Log probability of each word (in input order) under each column of prob."""
        n, m, ring_size = len(self.length), prob.shape[1], self.depth + 1
        ring = np.zeros((ring_size, n, m))
        ring[0] = 1
        scale = np.zeros((n, 1))
        out = np.zeros((n, m))
        for p in range(1, self.longest + 1):
            a = self.active[p]
            now = ring[(p - 1) % ring_size, :a] * BYTE_FLOOR
            for k, w, piece in self.arcs[p]:
                now[w] += ring[(p - k) % ring_size, w] * prob[piece]
            ring[p % ring_size, :a] = now
            done = slice(self.active[p + 1] if p < self.longest else 0, a)
            out[done] = np.log(now[done]) + scale[done]
            if p % 8 == 0:  # no underflow in long words
                top = now.max(1, keepdims=True)
                ring[:, :a] /= top
                scale[:a] += np.log(top)
        back = np.empty_like(out)
        back[self.order] = out
        return back

    def expected(self, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece over all words, each counted weight times (one language)."""
        n = len(self.length)
        alpha = np.zeros((self.longest + 1, n))
        alpha[0] = 1
        for p in range(1, self.longest + 1):
            a = self.active[p]
            alpha[p, :a] = alpha[p - 1, :a] * BYTE_FLOOR
            for k, w, piece in self.arcs[p]:
                alpha[p, w] += alpha[p - k, w] * prob[piece]
        beta = np.zeros((self.longest + 1, n))
        beta[self.length, np.arange(n)] = 1
        total = alpha[self.length, np.arange(n)]
        use = weight[self.order] / np.maximum(total, 1e-290)
        counts = np.zeros(len(prob))
        for p in range(self.longest, 0, -1):
            beta[p - 1] += beta[p] * BYTE_FLOOR
            for k, w, piece in self.arcs[p]:
                arc = beta[p, w] * prob[piece]
                beta[p - k, w] += arc
                counts += np.bincount(piece, weights=alpha[p - k, w] * arc * use[w], minlength=len(prob))
        return counts


def spaced_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words with a leading space: bytes, starts, ends; word number and row of each occurrence."""
    s, e, r = K.words(buf, off, K.LETTER)
    if not len(s):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint8), z, z, z, r
    _, first, number = np.unique(K.RangeHash(buf)(s, e), return_index=True, return_inverse=True)
    s, size = s[first], (e - s)[first]
    start = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(start[-1], 0x20, np.uint8)
    inner = np.ones(start[-1], bool)
    inner[start[:-1]] = False
    out[inner] = buf[np.repeat(s - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
    return out, start[:-1], start[1:], number, r


@dataclass
class Model:
    langs: list[str]
    prob: np.ndarray
    pieces: list[bytes]
    _table: list = field(default_factory=list)

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "prob": self.prob, "pieces": self.pieces, "_table": []}

    def log_scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(rows, languages) log probabilities of lower-case texts."""
        if not self._table:
            self._table.append(PieceTable(self.pieces))
        out = np.zeros((len(off) - 1, len(self.langs)))
        for i, j in K.groups(off, 2 << 20):
            words, s, e, number, r = spaced_words(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            step = max(1000, 400_000 // max(len(self.langs), 1))  # bounds the lattice
            for a in range(0, len(s), step):
                b = min(a + step, len(s))
                part = words[s[a] : e[b - 1]]
                logp = Lattice(part, s[a:b] - s[a], e[a:b] - s[a], self._table[0]).forward(self.prob)
                m = (number >= a) & (number < b)
                for c in range(len(self.langs)):
                    out[i:j, c] += np.bincount(r[m], weights=logp[number[m] - a, c], minlength=j - i)
        return out


def learned_parts(word: bytes) -> list[bytes]:
    """A word with its leading space, in parts of at most MAX_LEARNED bytes and a character."""
    out, a = [], 0
    while a < len(word):
        b = min(a + MAX_LEARNED, len(word))
        while b < len(word) and word[b] & 0xC0 == 0x80:
            b += 1
        out.append(b" " * (a == 0) + word[a:b])
        a = b
    return out


def fit(counts: dict[str, dict[bytes, int]], pieces: list[bytes], rounds: int = 4) -> Model:
    """Expectation maximisation for each language from its word counts."""
    langs = sorted(counts)
    table = PieceTable(pieces)
    prob = np.full((len(pieces), len(langs)), 1 / max(len(pieces), 1))
    for c, lang in enumerate(langs):
        parts = [(x, n) for w, n in counts[lang].items() for x in learned_parts(w)]
        words, weight = [w for w, _ in parts], np.array([n for _, n in parts], float)
        ends = np.cumsum([len(w) for w in words])
        buf = np.frombuffer(b"".join(words), np.uint8)
        blocks = []
        for a in range(0, len(words), 20_000):
            b = min(a + 20_000, len(words))
            lo = int(ends[a - 1]) if a else 0
            e = ends[a:b] - lo
            blocks.append((Lattice(buf[lo : ends[b - 1]], np.concatenate([[0], e[:-1]]).astype(np.int64), e, table), weight[a:b]))
        for _ in range(rounds):
            uses = sum(x.expected(prob[:, c], w) for x, w in blocks)
            prob[:, c] = (uses + 0.01) / (uses.sum() + 0.01 * len(pieces))
    return Model(langs, prob, pieces)


def train(docs: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 300, tokenizer: str = "piece_bpe_32k.model") -> Model:
    """train_on: which identifiers (column doc_id) may be learned from."""
    spark = docs.sparkSession
    prepare(spark)
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    ids = ids.where(train_on & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    sizes = stash(ids.groupBy("lang").agg(F.count(F.lit(1)).alias("lang_n")), "languages")
    if (n_langs := sizes.count()) > MAX_LANGS:
        raise ValueError(f"{n_langs} languages; at most {MAX_LANGS} are learned")
    if not n_langs:
        return Model([], np.zeros((0, 0)), [])
    # the first per_lang identifiers of each language in hash order; a hash bound leaves about twice as many to sort
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    near = ids.join(F.broadcast(sizes), "lang").where(place * F.col("lang_n") <= 2 * per_lang + 64).select("lang", "doc_id").distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    sample = near.withColumn("at", first).where(F.col("at") <= per_lang).drop("at")
    rows = ids.join(F.broadcast(sample), ["doc_id", "lang"])  # at most MAX_LANGS * per_lang rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = K.flat(pc.utf8_lower(b.column(1)))
            out = {"lang": [], "word": [], "n": []}
            for i in range(b.num_rows):
                words, s, e, number, _ = spaced_words(buf[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]))
                raw = words.tobytes()
                out["word"] += [raw[x + 1 : y] for x, y in zip(s, e, strict=True)]
                out["n"] += np.bincount(number, minlength=len(s)).tolist()
                out["lang"] += [b.column(0)[i].as_py()] * len(s)
            yield pa.RecordBatch.from_arrays([pa.array(out["lang"], pa.string()), pa.array(out["word"], pa.binary()), pa.array(out["n"], pa.int64())], ["lang", "word", "n"])

    found = rows.select("lang", "text").mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, dict[bytes, int]] = {x: {} for x in sorted(set(found["lang"].to_pylist()))}
    for lang, word, n in zip(*(found[c].to_pylist() for c in ("lang", "word", "n")), strict=True):
        counts[lang][word] = n
    return fit(counts, vocabulary(tokenizer)) if counts else Model([], np.zeros((0, 0)), [])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pc.fill_null(b.column(1), "")
            some = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
            names, score = np.array(["und"] * b.num_rows, object), np.zeros(b.num_rows)
            if model.langs and b.num_rows:
                z = model.log_scores(*K.flat(pc.utf8_lower(text)))
                best = z.argmax(1)
                post = 1 / np.exp(z - z.max(1, keepdims=True)).sum(1)
                names[some] = np.array(model.langs, object)[best[some]]
                score[some] = post[some]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def language_predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; languages of held-out documents are never read into the fit."""
    from parcelspark.llm.toxicity import held_out

    out = held_out(F.col("doc_id"), 3, 1)
    return predict(docs, train(docs, ~out)).select("doc_id", out.alias("held_out"), "lang_pred", "score")
