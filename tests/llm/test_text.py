import hashlib
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from parcelspark.llm import langid, packing, simhash, token_counts, toxicity
from parcelspark.llm import textkit as K
from parcelspark.llm.tokens import encoder

ALPHABET = [*" \n\tab1'sé。!  x", "<|endoftext|>", "<|end"]


def text(rnd, n):
    return "".join(rnd.choice(ALPHABET) for _ in range(n))


def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_reference_tokenizer():
    rnd, ref, enc = random.Random(2), reference(), encoder()
    texts = [text(rnd, rnd.randrange(60)) for _ in range(300)] + ["<|endoftext|> a", "it's  we'll 　x\x1c y", "漢字👍 naïve"]
    assert [enc.ids(t).tolist() for t in texts] == [x.ids for x in ref.encode_batch(texts, add_special_tokens=False)]


def test_packed_ids_equal_the_tokenizer_as_loaded(spark):
    ref = reference()
    rnd, end = random.Random(12), "<|endoftext|>"
    texts = ["hello <|endoftext|> world", end, end * 3, f"{end} a", f"a{end}", f"a\n{end}\n b <|endoftext |> <|END|>"]
    texts += [text(rnd, rnd.randrange(20)) + end + text(rnd, rnd.randrange(20)) for _ in range(100)] + ["no such token"]
    want = {i: x.ids for i, x in enumerate(ref.encode_batch(texts, add_special_tokens=False))}
    assert {i: encoder().ids(t).tolist() for i, t in enumerate(texts)} == want and 50256 in want[0]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in packing.pack(docs, width=8).collect():
        ids = np.array([*want[r.doc_id], 1], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_tree_counts_under_edits():
    rnd, enc = random.Random(1), encoder()
    for _ in range(300):
        t = text(rnd, rnd.randrange(60))
        tree = token_counts.TokenTree(t, enc, 2)
        assert tree.total == enc.count(t)
        for _ in range(4):
            a = rnd.randrange(70)
            b, new = a + rnd.randrange(12), text(rnd, rnd.randrange(6))
            lo = min(a, len(t))
            t = t[:lo] + new + t[max(min(b, len(t)), lo) :]
            tree.edit(a, b, new)
            assert tree.text == t and tree.total == enc.count(t)


def test_kept_trees_take_further_edits(spark):
    """Trees written and read again, edited twice; nothing but the edited leaves is encoded."""
    from pyspark.sql import functions as F

    from parcelspark.scratch import stash

    rnd, enc = random.Random(3), encoder()
    texts = {i: text(rnd, rnd.randrange(400)) for i in range(30)}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, leaves string").repartition(3)
    trees = stash(token_counts.build_trees(docs), "trees")
    one = F.array(F.struct(F.lit(10).alias("start"), F.lit(15).alias("stop"), F.lit(" new ").alias("new")))
    for _ in range(2):
        got = {r.doc_id: r for r in token_counts.apply_edits(trees, one).collect()}
        trees = stash(token_counts.apply_edits(trees, one, new_trees=True), "trees")
        for i, t in texts.items():
            texts[i] = t[:10] + " new " + t[15:]
            assert (got[i].n_tokens, got[i].edited_tokens) == (enc.count(t), enc.count(texts[i]))
    assert {r.doc_id: "".join(r.leaves) for r in trees.collect()} == texts


def test_edits_reencode_little():
    enc = encoder()
    t = "some plain words here " * 2000
    tree = token_counts.TokenTree(t, enc)
    tree.edit(20_000, 20_010, "new")
    assert tree.reencoded < 500 and tree.total == enc.count(t[:20_000] + "new" + t[20_010:])


def test_token_count_query(spark, cases, empty):
    from pyspark.sql import functions as F

    enc = encoder()
    for r in token_counts.token_counts(cases.select("doc_id", "text"), token_counts.revision(F.col("text"))).collect():
        assert r.n_edits == 3
    got = sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.token_counts(cases).collect())
    assert got == sorted((r.doc_id or 0, enc.count(r.text or "")) for r in cases.select("doc_id", "text").collect())
    t = "one two three four five six seven eight nine ten eleven twelve thirteen"
    n = len(t)
    a, b, c = 3 * n // 4, n // 2, n // 4
    u = t[:a] + "[edited]" + t[a + 12 :]
    u = u[:b] + " inserted words, " + u[b:]
    u = u[:c] + u[c + 24 :]
    r = token_counts.token_counts(spark.createDataFrame([(1, t)], "doc_id long, text string"), token_counts.revision(F.col("text"))).first()
    assert (r.n_tokens, r.edited_tokens) == (enc.count(t), enc.count(u))
    assert token_counts.token_counts(empty).count() == 0


def test_packing_is_a_round_trip(cases, empty):
    enc = encoder()
    want = sorted(((r.doc_id if r.doc_id is not None else -1), enc.ids(r.text or "").tolist() + [1]) for r in cases.select("doc_id", "text").collect())
    rows = packing.pack(cases).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id if r.doc_id is not None else -1].append(r)
        by_seq[r.sequence_id].append(r)
    for doc, ids in want:
        if doc != 6:  # 6 is there twice
            at = 0
            for r in sorted(by_doc[doc], key=lambda r: r.start):
                part = ids[r.start : r.start + r.length]
                assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
                at += r.length
            assert at == len(ids)
    assert sum(r.length for r in by_doc[6]) == 4
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0  # 2048 is a power of two as well
    assert packing.pack(empty).count() == 0


def test_sum_of_squares_takes_the_best_level():
    rnd, done = random.Random(5), []
    p = packing.SumOfSquares(16, done.append)
    for _ in range(500):
        s = rnd.randrange(1, 16)
        n = p.count.copy()

        def after(level, n=n, s=s):
            m = n.copy()
            if level:
                m[level] -= 1
            if level + s < 16:
                m[level + s] += 1
            return int((m * m).sum())

        options = [h for h in range(0, 17 - s) if h == 0 or n[h]]
        best = min(after(h) for h in options)
        assert p.choose(s) == max(h for h in options if after(h) == best)
        p.add(packing.Piece(0, 0, b"\0" * 4 * s, s))
    p.close()


def test_forward_sums_all_segmentations():
    pieces = [b" ", b" a", b"a", b"b", b"ab", b"aa"]
    prob = np.array([[0.1, 0.2], [0.2, 0.1], [0.3, 0.3], [0.1, 0.1], [0.2, 0.2], [0.1, 0.1]])

    def brute(w, c):
        if not w:
            return 1.0
        return sum(prob[pieces.index(w[:k]), c] * brute(w[k:], c) for k in range(1, len(w) + 1) if w[:k] in pieces) + langid.BYTE_FLOOR * brute(w[1:], c)

    words = [b" aab", b" ab", b" baa", b" c", b" aaaaaaaaaaaab"]
    ends = np.cumsum([len(w) for w in words])
    lattice = langid.Lattice(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends, langid.PieceTable(pieces))
    assert np.allclose(np.exp(lattice.forward(prob)), [[brute(w, 0), brute(w, 1)] for w in words], rtol=1e-9)
    assert np.isfinite(langid.Lattice(np.frombuffer(b" " + b"q" * 500, np.uint8), np.array([0]), np.array([501]), langid.PieceTable(pieces)).forward(prob)).all()


def test_expected_uses_equal_brute_force():
    """Posterior piece counts over all segmentations, and long pieces of several bytes a letter."""
    pieces = [b" ", b" a", b"a", b"b", b"ab", b"aa", "漢字漢字漢字".encode(), "漢字".encode()]
    prob = np.array([0.1, 0.2, 0.3, 0.1, 0.2, 0.1, 0.05, 0.02])
    words, weight = [b" aab", b" ab", b" baa", " 漢字漢字漢字a".encode()], np.array([2.0, 1.0, 3.0, 1.5])

    def paths(w):
        if not w:
            yield 1.0, []
            return
        for i, x in enumerate(pieces):
            if w.startswith(x):
                for p, rest in paths(w[len(x) :]):
                    yield p * prob[i], [i, *rest]
        for p, rest in paths(w[1:]):
            yield p * langid.BYTE_FLOOR, rest

    want, total = np.zeros(8), []
    for w, n in zip(words, weight, strict=True):
        every = list(paths(w))
        z = sum(p for p, _ in every)
        total.append(z)
        for p, used in every:
            for i in used:
                want[i] += n * p / z
    ends = np.cumsum([len(w) for w in words])
    table = langid.PieceTable(pieces)
    lattice = langid.Lattice(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends, table)
    assert np.allclose(lattice.expected(prob, weight), want) and want[6] > 0
    assert np.allclose(np.exp(lattice.forward(prob[:, None]))[:, 0], total)


def test_the_whole_vocabulary_counts():
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = {sp.id_to_piece(i).lower().replace("▁", " ").encode() for i in range(sp.get_piece_size()) if sp.id_to_piece(i).removeprefix("▁").isalpha()}
    assert letters <= set(langid.vocabulary())
    assert b"".join(langid.learned_parts("漢字".encode() * 50)) == b" " + "漢字".encode() * 50
    assert all(x.decode() for x in langid.learned_parts("aé漢字".encode() * 50))


def test_language_of_held_out_documents(spark, cases, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.language_predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert len(rows) == 1000 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    got = {r.doc_id: r for r in langid.language_predictions(cases).collect()}
    assert got[3].lang_pred == got[4].lang_pred == "und" and got[3].score == 0 and got[1].lang_pred == "en"
    assert langid.language_predictions(empty).count() == 0


def test_fingerprints_equal_brute_force():
    """Votes of word pairs recounted one by one, and very long words in whatever company."""
    long = "x" * 200_000 + " y " + "z" * 300_000
    texts = ["a b c", "one", "", "é 漢字 ab é 漢字", long, "tail words here"]
    buf, off = K.flat(pa.array(texts))
    got = simhash.fingerprints(buf, off)
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        words = t.split()
        h = [int(x) for x in K.word_hashes(raw, np.array([0, len(raw)]), ~K.SPACE)[0]]
        terms = [(int((K.mix(np.array([a], K.U)) * K.U(0x9E3779B97F4A7C15) + K.U(b))[0]), len(u.encode()) + len(v.encode())) for a, b, u, v in zip(h, h[1:], words, words[1:], strict=False)] or [(a, len(u.encode())) for a, u in zip(h, words, strict=True)]
        votes = np.zeros(128)
        for t_hash, weight in terms:
            x = np.array([t_hash], K.U)
            bits = np.unpackbits(np.stack([K.mix(x), K.mix(x ^ K.U(0xA5A5A5A55A5A5A5A))], 1).view(np.uint8))
            votes += np.where(bits, weight, -weight)
        want = np.packbits(votes > 0).view(K.U) if terms else np.zeros(2, K.U)
        assert (got[i] == want).all()
        assert (simhash.fingerprints(*K.flat(pa.array([t])))[0] == want).all()


def test_simhash_edited_texts(spark, cases, empty):
    rnd = random.Random(4)
    rows = [(3 * i, text(rnd, rnd.randrange(50))) for i in range(97)]
    for buckets in (1, 5):
        got = {r.doc_id: r for r in simhash.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), buckets=buckets).collect()}
        assert len(got) == len(rows)
        for (i, t), (j, u) in zip(rows, rows[1:] + rows[:1], strict=True):
            k = len(t) // 4
            r = got[i]
            assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - k] + u[:k]).encode()).hexdigest()
            bits = bin(int(r.fingerprint, 16) ^ int(got[j].fingerprint, 16)).count("1")
            assert r.near_next == pytest.approx(1 - bits / 128)
            (fe,) = simhash.hexes(simhash.fingerprints(*K.flat(pa.array([t[: len(t) - k] + u[:k]]))))
            assert r.edited_fingerprint == fe and r.near_edited == pytest.approx(1 - (int(r.fingerprint, 16) ^ int(fe, 16)).bit_count() / 128)
    one = simhash.edited_likeness(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert simhash.edited_likeness(cases).count() == 14
    assert simhash.edited_likeness(empty).count() == 0


def test_hot_identifiers_are_split(spark):
    """Most rows without an identifier, or under one: they spread over buckets, and each has its successor once."""
    from pyspark.sql import functions as F

    rows = [(None, f"none {i} {'x' * (i % 9)}") for i in range(300)] + [(7, f"seven {i} {'y' * (i % 7)}") for i in range(300)] + [(i, f"text {i}") for i in range(20, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    order = [r[1:] for r in sorted(docs.select(F.xxhash64("text"), "doc_id", "text").collect(), key=lambda r: (r[1] is not None, r[1] or 0, r[0]))]
    want = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        k = len(t) // 4
        want.append((i, len(t), hashlib.sha256((t[: len(t) - k] + u[:k]).encode()).hexdigest()))
    out = simhash.edited_likeness(docs, buckets=8)
    got = out.select("doc_id", "n_chars", "edited_sha256", F.spark_partition_id().alias("p")).collect()
    assert sorted((tuple(r)[:3] for r in got), key=repr) == sorted(want, key=repr)
    for i in (None, 7):
        assert len({r.p for r in got if r.doc_id == i}) > 2


@pytest.mark.parametrize("lead", [8, 10])
def test_any_leading_bits_find_all_within_the_radius(spark, lead):
    rnd = random.Random(lead)
    base = [rnd.getrandbits(128) for _ in range(6)]
    fps = {b ^ sum(1 << x for x in rnd.sample(range(128), rnd.randrange(1, 26))) for b in base for _ in range(4)}
    df = spark.createDataFrame([(f"{x:032x}", 1, i % 3 == 0) for i, x in enumerate(sorted(fps))], "fingerprint string, n long, asked boolean")
    got = {r.fingerprint: r.near for r in simhash.near_counts(df, lead=lead).collect()}
    assert got == {f"{a:032x}": sum((a ^ b).bit_count() <= simhash.RADIUS for b in fps) for i, a in enumerate(sorted(fps)) if i % 3 == 0}


def test_neighbours_are_counted(spark, empty):
    rows = [(i, " ".join(str(j) for j in range(30 + (i % 3) * 40))) for i in range(60)] + [(100, "1 2 3"), (150, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.with_neighbours(simhash.edited_likeness(docs), radius=3, every=10).collect()
    assert len(got) == len(rows)
    for r in got:
        close = sum((int(r.fingerprint, 16) ^ int(o.fingerprint, 16)).bit_count() <= 3 for o in got) - 1
        assert r.n_near == (close if r.doc_id % 10 == 0 else None)
    assert simhash.with_neighbours(simhash.edited_likeness(empty)).count() == 0


def test_toxicity_where_every_document_has_a_label(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choices([f"plain{j}" for j in range(80)], k=30) + ["vile", "foul", "nasty"] * (i % 10 == 0))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i, _ in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxic_scores(docs, labels).collect()}
    assert len(got) == 600 and sum(got[i] != int(i % 10 == 0) for i in got) <= 6


def test_all_fingerprints_within_a_wide_radius_are_counted(spark):
    rnd = random.Random(8)
    fps = {rnd.getrandbits(128) for _ in range(40)}
    for x in list(fps):
        for d in (1, 5, 12, 17, 18, 19, 24):
            fps.add(x ^ sum(1 << b for b in rnd.sample(range(128), d)))
    rows = [(f"{x:032x}", 1 + x % 3, x % 4 == 0) for x in fps]
    df = spark.createDataFrame(rows, "fingerprint string, n long, asked boolean").repartition(3)
    for radius in (0, 3, simhash.RADIUS):
        got = {r.fingerprint: r.near for r in simhash.near_counts(df, radius).collect()}
        assert got == {f"{x:032x}": sum(1 + y % 3 for y in fps if (x ^ y).bit_count() <= radius) for x in fps if x % 4 == 0}


def test_near_copies_count_as_neighbours(spark):
    """Copies with words replaced to a 5-gram Jaccard similarity of 0.8 or a little more."""
    rnd = random.Random(9)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 10))) for _ in range(2000)]
    rows = []
    for i in range(200):
        words = rnd.choices(vocab, k=rnd.choice([100, 200, 400]))
        near = list(words)
        for j in rnd.sample(range(len(near)), len(near) * 2 // 100):
            near[j] = rnd.choice(vocab)
        rows += [(50 * i, " ".join(words)), (50 * i + 1, " ".join(near))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.n_near for r in simhash.with_neighbours(simhash.edited_likeness(docs)).where("n_near IS NOT NULL").collect()]
    assert len(got) == 200 and sum(n == 1 for n in got) >= 180 and max(got) == 1


def test_shingles_of_short_texts():
    buf = np.frombuffer(b"a b c d e f|a b|x".replace(b"|", b" "), np.uint8)
    h, r, _ = K.word_hashes(buf, np.array([0, 12, 16, 17]), ~K.SPACE)
    sh, sr = K.shingle_hashes(h, r, 3, 5)
    assert sr.tolist() == [0, 0, 1, 2] and len(set(sh.tolist())) == 4


def test_words_across_blocks():
    raw = b"abc defgh " * 50
    buf, off = np.frombuffer(raw, np.uint8), np.array([0, 95, 95, len(raw)])
    a, b = K.word_hashes(buf, off, ~K.SPACE), K.word_hashes(buf, off, ~K.SPACE, limit=7)
    assert all((x == y).all() for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("bias", [-1.0, -9.0])
def test_nnpu_gradient(bias):
    """The risk against its definition and the step against differences, where the second part is bounded and where not."""
    rng = np.random.default_rng(1)
    docs = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(25)]
    col, row = np.concatenate(docs), np.repeat(np.arange(25), [len(x) for x in docs])
    w, prior, n_pos = np.append(rng.normal(0, 1, 6), bias), 0.3, 8
    if bias == -9.0:
        w[:6] = np.where(rng.random(6) < 0.5, 9.0, 0.0)
        col, row = np.concatenate([np.arange(6)] * 8 + [np.zeros(0, int)]), np.repeat(np.arange(8), 6)

    def parts(w):
        z = np.array([w[col[row == i]].sum() for i in range(25)]) + w[-1]
        loss = lambda x: np.log1p(np.exp(-x))
        return prior * loss(z[:8]).mean(), loss(-z[8:]).mean() - prior * loss(-z[:8]).mean()

    first, second, grad = toxicity.risk(w, col, row, n_pos, 25, prior)
    assert (first, second) == pytest.approx(parts(w)) and (second < 0) == (bias == -9.0)
    aim = lambda w: sum(parts(w)) if second >= 0 else -parts(w)[1]
    for i in range(7):
        d = np.zeros(7)
        d[i] = 1e-6
        assert grad[i] == pytest.approx((aim(w + d) - aim(w - d)) / 2e-6, abs=1e-6)


def test_prefixes_are_whole_characters():
    raw = "naïveté Ünïcödé".encode()
    buf = np.frombuffer(raw, np.uint8)
    h, _ = toxicity.terms(buf, np.array([0, len(raw)]))
    low = K.LOWER[buf]
    rh, want = K.RangeHash(low), set()
    for a, b in ((0, len("naïveté".encode())), (len("naïveté ".encode()), len(raw))):
        word = low[a:b].tobytes().decode()
        want.add(int(rh(np.array([a]), np.array([b]))[0]))
        for k in range(3, 7):
            want.add(int((rh(np.array([a]), np.array([a + len(word[:k].encode())])) ^ K.U(k))[0]))
    assert set(h.tolist()) == want


def test_toxicity_learns_from_each_identifier_once(spark):
    """Ten thousand rows of one unlabelled and of one labelled identifier."""
    from pyspark.sql import functions as F

    hot = spark.range(20_000).selectExpr("id % 2 AS doc_id", "concat('word ', id) AS text")
    docs = hot.unionByName(spark.range(2, 300).selectExpr("id AS doc_id", "concat('some text ', id) AS text"))
    labels = spark.createDataFrame([(1, 1), *((i, int(i % 4 == 0)) for i in range(2, 100))], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels.withColumnRenamed("toxic", "y"), F.lit(True), "doc_id", "text", 10, 150).groupBy("p").count().collect()
    assert {r.p: r["count"] for r in rows} == {1: 10, 0: 150}
    assert toxicity.score(docs, toxicity.train(docs, labels, F.lit(True))).count() == docs.count()


def test_toxicity_of_unlike_texts_of_one_identifier(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choices([f"plain{j}" for j in range(80)], k=30) + ["vile", "foul", "nasty"] * (i % 10 == 0))) for i in range(600)]
    rows += [(1000, "plain1 plain2"), (1000, "plain1 vile foul nasty"), (None, "vile foul nasty"), (None, None)]
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(0, 600, 3)], "doc_id long, toxic int")
    got = toxicity.toxic_scores(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert len(got) == 604 and sorted(r.predicted for r in got if r.doc_id == 1000) == [0, 1] and sorted(r.predicted for r in got if r.doc_id is None) == [0, 1]


def test_nnpu_separates(spark, cases, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxic_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good = [r for r in rows if r.toxic == 0]
    bad = [r for r in rows if r.toxic == 1]
    assert sum(r.predicted for r in good) <= 0.03 * len(good) and sum(r.predicted for r in bad) >= 0.75 * len(bad)
    some = spark.createDataFrame([(1, 1), (2, None), (5, 0), (11, 1)], "doc_id long, toxic int")
    for d in (cases, empty):
        for y in (some, some.where("false")):
            assert toxicity.toxic_scores(d, y).count() == d.count()
