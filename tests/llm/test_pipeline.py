from collections import defaultdict

import corpus_pipeline
from parcelspark.llm import mixing, toxicity
from test_dedup import brute_links, norm


def test_each_stage_on_its_input(spark):
    """Each stage against brute force on what the one before it kept."""
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    labels = spark.read.parquet(f"{sf}/labels.parquet")

    clean = stages[0](spark, docs, sf).cache()
    model = toxicity.train(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    low = {r.doc_id for r in toxicity.score(docs, model).where("score < 0.5").collect()}
    assert {r.doc_id for r in clean.collect()} == low and clean.columns == docs.columns

    one = stages[1](spark, clean, sf).cache()
    first = {}
    for r in sorted(clean.collect(), key=lambda r: r.doc_id):
        first.setdefault(norm(r.text), r.doc_id)
    assert {r.doc_id for r in one.collect()} == set(first.values()) and one.columns == docs.columns

    apart = stages[2](spark, one, sf).cache()
    links = brute_links([(r.doc_id, r.text) for r in one.collect()])
    assert {r.doc_id for r in apart.collect()} == {i for i, (c, _, _) in links.items() if c == i} and apart.columns == docs.columns

    mixed = stages[3](spark, apart, sf).cache()
    plan = {r.doc_id: r.copies for r in mixing.mixing_plan(apart).collect()}
    count = defaultdict(int)
    for r in mixed.collect():
        count[r.doc_id] += 1
    assert dict(count) == {k: v for k, v in plan.items() if v} and mixed.columns == docs.columns

    packed = stages[4](spark, mixed, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(count)


def test_stages_on_edge_cases(spark, cases, empty):
    """Nulls, empties, ties, repeated rows, long texts and clashing columns; and no rows at all."""
    sf = "/root/testdata/sf0.001"
    docs, none = cases, empty
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs, none = stage(spark, docs, sf).cache(), stage(spark, none, sf)
        assert none.count() == 0 and (i == 4 or docs.columns == none.columns == cases.columns)
        ids = sorted(repr(r.doc_id) for r in docs.select("doc_id").collect())
        if i == 1:
            assert ids == sorted(map(repr, [1, 3, 5, 7, 8, 9, 10, 11]))
        if i == 2:
            assert ids == sorted(map(repr, [1, 3, 5, 8, 9, 10, 11]))


def test_packed_sequences_hold_what_was_mixed(spark):
    """The last stage against the tokenizer: every id of every mixed row, once, in gapless sequences."""
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    mixed = corpus_pipeline.mix_sources(spark, docs, "").cache()
    count = defaultdict(int)
    for r in mixed.collect():
        count[r.doc_id] += 1
    text, got, ends = {r.doc_id: r.text for r in docs.collect()}, defaultdict(lambda: defaultdict(int)), defaultdict(list)
    for r in corpus_pipeline.pack_sequences(spark, mixed, "").collect():
        ids = np.array([*ref.encode(text[r.doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        assert r.doc_tokens == len(ids) and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        for at in range(r.start, r.start + r.length):
            got[r.doc_id][at] += 1
        ends[r.sequence_id].append((r.offset, r.offset + r.length))
    assert {i: set(at.values()) for i, at in got.items()} == {i: {n} for i, n in count.items()}
    for spans in ends.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[-1][1] <= 2048


def test_repeated_and_null_identifiers(spark):
    words = lambda k, n=60: [f"w{k}x{i}" for i in range(n)]
    a, b, c, d, e = (" ".join(words(k)) for k in range(5))
    near = " ".join([*words(3)[:-1], "other"])
    rows = [(1, a), (1, a), (1, a.replace(" ", "  ", 1)), (2, a), (2, b), (None, a), (None, c), (None, c), (None, d), (4, near), (5, e), (5, e), (None, near)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    one = corpus_pipeline.drop_copies(spark, docs, "").cache()
    got = sorted(((r.doc_id, norm(r.text)) for r in one.collect()), key=repr)
    assert got == sorted([(1, norm(a)), (2, norm(b)), (None, norm(c)), (None, norm(d)), (4, norm(near)), (5, norm(e))], key=repr)
    assert one.columns == docs.columns
    two = spark.createDataFrame([(7, d, 1), (7, b, 2), (8, near, 3), (None, c, 4), (None, near, 5), (None, e, 6)], "doc_id long, text string, n int")
    apart = corpus_pipeline.drop_near_copies(spark, two, "")
    assert apart.columns == two.columns
    assert sorted(r.n for r in apart.collect()) == [2, 3, 4, 6]
