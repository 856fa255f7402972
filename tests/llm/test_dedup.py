import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parcelspark.llm import exact_dedup, ngram_join, suffix_dedup


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_dedup_verifies_bytes(spark, digest_bytes):
    """With one-byte digests most hits are collisions, and only the bytes tell them apart."""
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice("abcde") for _ in range(rnd.randrange(4)))) for i in range(200)] + [(900, None), (901, "")]
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, rows), digest_bytes=digest_bytes).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        g, r = groups[norm(t)], got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(g), len(g), i == min(g), hashlib.sha256(norm(t).encode()).hexdigest())


def test_exact_dedup_cases(cases, empty):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(cases).collect()}
    assert len(got) == 13  # the repeated row is one document
    assert got[None].keep_id == 1 and got[2].keep_id == 1 and not got[None].kept
    assert got[6].keep_id == 5 and got[5].group_size == 3
    assert got[4].keep_id == 3 and got[7].kept
    assert exact_dedup.exact_dedup(empty).count() == 0


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_index_lookup_verifies_bytes(spark, digest_bytes):
    """Several flushes and levels; with one-byte digests most hits are collisions."""
    rnd = random.Random(2)
    index, known = exact_dedup.DigestIndex(digest_bytes), {}
    for batch in range(5):
        rows = [(batch * 100 + i, " ".join(rnd.choice("abcd") for _ in range(rnd.randrange(5)))) for i in range(30)]
        index.add(frame(spark, rows))
        for i, t in rows:
            known[norm(t)] = min(i, known.get(norm(t), i))
    assert [len(x) for x in index.levels] == [1, 0, 1]  # five flushes, two by two
    ask = [(i, " ".join(rnd.choice("abcde") for _ in range(rnd.randrange(5)))) for i in range(60)] + [(None, None)]
    got = sorted(((r.doc_id, r.keep_id) for r in index.lookup(frame(spark, ask)).collect()), key=repr)
    assert got == sorted(((i, known.get(norm(t))) for i, t in ask), key=repr)
    assert exact_dedup.DigestIndex().lookup(frame(spark, ask)).where("keep_id IS NULL").count() == len(ask)


def test_filter_passes_all_that_it_holds(spark):
    digests = lambda a, b: spark.range(a, b).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    met = exact_dedup.Filter(digests(0, 5000), 5000)
    assert met.passing(digests(0, 5000)).where("NOT passes").count() == 0
    assert met.passing(digests(5000, 25000)).where("passes").count() < 0.1 * 20000


def cut(rows, width):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            if w in seen:
                gone[p : p + width] = True
            seen.add(w)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("seed", "block"), [(1, 1 << 21), (2, 1 << 21), (3, 50)])
def test_suffix_dedup_equals_brute_force(spark, seed, block):
    rnd = random.Random(seed)
    text = lambda n, a="ab cé": "".join(rnd.choice(a) for _ in range(n))
    parts = [text(rnd.randrange(5, 60)) for _ in range(12)]
    rows = [(i, "".join(rnd.choice(parts) if rnd.random() < 0.4 else text(rnd.randrange(1, 40), "abcdefgh ") for _ in range(rnd.randrange(0, 9)))) for i in range(80)]
    rows += [(100, "z" * 300), (101, "zy" * 200), (102, None), (103, "z" * 19), (104, "z" * 20)]
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.suffix_dedup(frame(spark, rows), width=20, gram=9, bucket_rows=40, block=block).collect()}
    assert got == cut(rows, 20)


def test_suffix_dedup_cases(cases, empty):
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(cases).collect()}
    want = cut([(i if i is not None else -1, t) for i, t in {(r.doc_id, r.text) for r in cases.select("doc_id", "text").collect()}], 100)
    assert {k if k is not None else -1: tuple(r)[1:] for k, r in got.items()} == want
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_suffix_dedup_keeps_unlike_texts_of_one_identifier(spark):
    a, b, c = ("".join(random.Random(k).choices("abcdefgh", k=400)) for k in range(3))
    rows = [(1, a), (7, a), (7, b), (7, b), (None, c), (None, b[:150]), (9, c)]
    got = sorted((r.n_bytes, r.n_removed, repr(r.doc_id)) for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect())
    assert got == sorted([(400, 0, "1"), (400, 400, "7"), (400, 150, "7"), (400, 150, "7"), (400, 0, "None"), (150, 0, "None"), (400, 400, "9")])


def test_suffix_dedup_of_long_texts(spark):
    """Texts beyond one block: a passage across the border of blocks, and a copy far inside another text."""
    rnd = np.random.default_rng(5)
    letters = lambda n: rnd.integers(97, 123, n, dtype=np.uint8).tobytes().decode()
    x, y = letters(5_000_000), letters(300)
    x = x[: (1 << 20) - 150] + y + x[(1 << 20) + 150 :]
    z = letters(2_500_000) + x[3_000_000:3_000_500] + y + letters(10)
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(frame(spark, [(1, x), (2, z)])).collect()}
    assert got[1].n_removed == 0 and (got[2].n_removed, got[2].n_spans) == (800, 1)
    assert got[2].kept_sha256 == hashlib.sha256((z[:2_500_000] + z[-10:]).encode()).hexdigest()


def test_suffix_dedup_windows_of_many_ranges_in_one_batch():
    """Ranges of windows are hashed together: a batch for a block of bytes, not one for each range."""
    rnd = np.random.default_rng(3)
    texts = [rnd.integers(97, 99, n, dtype=np.uint8).tobytes().decode() for n in (4000, 50, 3000)]
    spans = [[{"lo": a, "hi": a + 3} for a in range(3000, -1, -30)], [], [{"lo": 5, "hi": 2900}, {"lo": 0, "hi": 4}]]
    rows = pa.RecordBatch.from_arrays(
        [pa.array([7, 8, 9]), pa.array([0, 0, 1]), pa.array(texts), pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))],
        ["doc", "tag", "text", "spans"],
    )
    want = [(d, t, p) for d, t, s in ((7, 0, spans[0]), (9, 1, spans[2])) for x in s[::-1] for p in range(x["lo"], min(x["hi"], 2900 if d == 9 else 3900) + 1)]
    for block in (1 << 20, 700):
        got = list(suffix_dedup._map_windows(100, block)(iter([rows])))
        assert block == 700 or len(got) == 1
        places = [x for b in got for x in zip(*(b.column(i).to_pylist() for i in (3, 4, 5)), strict=True)]
        assert places == want
        keys = [x for b in got for x in zip(*(b.column(i).to_pylist() for i in (0, 1, 2)), strict=True)]
        content = [texts[d - 7][p : p + 100] for d, _, p in places]
        assert len(set(keys)) == len(set(content)) == len(set(zip(keys, content, strict=True)))


def test_suffix_dedup_candidates_share_a_side_of_their_anchor():
    """Phrases of 50 bytes in common make no candidates; no window in common is lost."""
    rnd = np.random.default_rng(4)
    letters = lambda n: rnd.integers(97, 123, n, dtype=np.uint8).tobytes()
    for shared in (50, 100, 130):
        phrase = [letters(shared) for _ in range(20)]
        texts = [b"".join(letters(int(rnd.integers(80, 200))) + p for p in phrase) + letters(200) for _ in range(3)]
        buf, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
        r, lo, hi, lead, gram, unit, at, sides = suffix_dedup.units(buf, off, 100, 32)
        cols = (lead, gram, unit, r, np.zeros_like(r), lo, hi, at, sides)
        rows = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [x.split()[0] for x in suffix_dedup.UNIT.split(", ")][1:])
        found = [x for b in suffix_dedup._sort_units(34)(iter([rows])) for x in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True)]
        again, kept = ({(d, p) for k, d, a, z in found if k == kind for p in range(a, z + 1)} for kind in (1, 2))
        places = {}
        for d, t in enumerate(texts):
            for p in range(len(t) - 99):
                places.setdefault(t[p : p + 100], []).append((d, p))
        left = [[x for x in v if x not in again] for v in places.values()]
        assert {x for v in left if len(v) > 1 for x in v} <= kept
        # two groups at the bucket's ends are kept whole
        assert shared > 50 or len(kept) < 250


def test_multikey_order():
    rng = np.random.default_rng(0)
    keys = [rng.integers(0, 4, 500) for _ in range(4)]
    o = suffix_dedup.multikey_order(keys)
    rows = list(zip(*(k[o] for k in keys), strict=True))
    assert rows == sorted(rows)


def brute_links(rows, n=5, threshold=0.8):
    words = {i: tuple(w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w) for i, t in rows}
    rep = {}
    for i in sorted(words):
        rep.setdefault(words[i], i)
    sets = {i: {w[k : k + n] for k in range(max(1, len(w) - n + 1))} if w else set() for w, i in rep.items()}
    near = defaultdict(set)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                near[a].add(b)
                near[b].add(a)
    label = {}
    for i in sorted(sets):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = label.get(i, i)
                todo += near[x]
    return {i: (label[rep[w]], len(near[rep[w]]), rep[w]) for i, w in words.items()}


@pytest.mark.parametrize(("block_docs", "block_grams"), [(512, 1 << 20), (30, 1 << 20), (7, 1 << 20), (512, 3000)])
def test_ngram_join_equals_brute_force(spark, block_docs, block_grams):
    """A group of near copies in which not all are linked to all, in one group, by band buckets, and by pairs of blocks."""
    rnd = random.Random(3)
    base = [str(rnd.randrange(10**6)) for _ in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rnd.randrange(0, 5)):
            w[rnd.randrange(len(w))] = str(rnd.randrange(10**6))
        rows.append((i, " ".join(w)))
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    rows += [(200 + i, " ".join(str(rnd.randrange(10**6)) for _ in range(rnd.randrange(0, 30)))) for i in range(40)]
    rows += [(300, "one two"), (301, "one  two"), (302, None), (303, "")]
    got = {r.doc_id: (r.class_id, r.n_links, r.rep_id) for r in ngram_join.jaccard_join(frame(spark, rows), block_docs=block_docs, block_grams=block_grams).collect()}
    assert got == brute_links(rows)
    assert max(Counter(c for c, _, _ in got.values()).values()) > 40


def test_ngram_join_cases(cases, empty):
    rows = ngram_join.jaccard_join(cases).collect()
    assert len(rows) == 14 and all(r.n_links == 0 for r in rows)
    assert {r.class_id for r in rows if r.doc_id in (3, 4, 7)} == {3}
    assert ngram_join.jaccard_join(empty).count() == 0


def test_ngram_join_of_repeated_and_null_identifiers(spark):
    """No text is skipped because another has its identifier, and none gets another's class."""
    words = lambda k, n=60: " ".join(f"w{k}x{i}" for i in range(n))
    a, c = words(1), words(2)
    near = a.rsplit(" ", 1)[0] + " other"
    rows = [(1, c), (7, a), (7, c + " tail"), (8, near), (None, near + " more"), (9, a), (9, a), (2**62, words(3)), (None, words(4)), (None, words(4))]
    got = ngram_join.jaccard_join(frame(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.class_id, []).append((r.doc_id, r.n_links))
    assert sorted(by[1]) == [(1, 1), (7, 1)]
    assert sorted(by[8], key=repr) == sorted([(7, 2), (8, 2), (9, 2), (9, 2), (None, 2)], key=repr)
    assert sorted(len(v) for v in by.values()) == [1, 2, 2, 5]
    one = ngram_join.one_of_each(frame(spark, rows).withColumn("rep", F.lit("x")))
    assert one.columns == ["doc_id", "text", "rep"]
    assert sorted(((r.doc_id, r.text) for r in one.collect()), key=repr) == sorted([(1, c), (8, near), (2**62, words(3)), (None, words(4))], key=repr)


def test_bands_reach_the_recall():
    for t in (0.5, 0.8, 0.9):
        bands, rows = ngram_join.choose_bands(t, 0.999, 400)
        assert 1 - (1 - t**rows) ** bands >= 0.999 and bands * rows <= 400


def join_rows(spark, since, key):
    """The largest number of rows that one join on `key` alone made in executions after `since`, and the last execution."""
    store = spark._jsparkSession.sharedState().statusStore()
    every = store.executionsList()
    most, last = 0, since
    for i in range(every.size()):
        at = every.apply(i).executionId()
        last = max(last, at)
        if at <= since:
            continue
        known, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for k in range(nodes.size()):
            n = nodes.apply(k)
            if not re.search(rf"Join \[{key}#\d+L?\], \[{key}#\d+L?\]", n.desc()):
                continue
            for j in range(n.metrics().size()):
                m = n.metrics().apply(j)
                got = known.get(m.accumulatorId())
                if m.name() == "number of output rows" and got.isDefined():
                    most = max(most, int(got.get().replace(",", "")))
    return most, last


def test_near_copies_join_once_on_their_key(spark):
    """Joins on a representative make one row of each, whatever its bands and the size of its group."""
    rnd = random.Random(5)
    base = [str(rnd.randrange(10**6)) for _ in range(200)]
    rows = [(i, " ".join(base[: 20 + i // 2] + [f"x{i}"] + base[20 + i // 2 :])) for i in range(300)]
    _, since = join_rows(spark, -1, "rep")
    got = ngram_join.jaccard_join(frame(spark, rows), block_docs=40).collect()
    assert len({r.class_id for r in got}) == 1 and all(r.n_links == 299 for r in got)
    most, _ = join_rows(spark, since, "rep")
    assert 0 < most <= 300
