from collections import Counter, defaultdict

import numpy as np
import pytest

from parcelspark.llm import mixing


def test_exponent_meets_entropy_and_repeats():
    t = np.array([1000.0, 100.0, 10.0])
    a = mixing.choose_exponent(t, 1.0, None, t.sum())
    assert mixing.entropy(mixing.tempered(t, a)) == pytest.approx(1.0, abs=1e-6)
    b = mixing.choose_exponent(t, 1.0, 2.0, t.sum())
    assert b > a and (t.sum() * mixing.tempered(t, b) / t).max() <= 2 + 1e-6
    assert mixing.choose_exponent(t, 0.0001, None, t.sum()) == 1.0


def test_copies_realise_the_weights(spark):
    rows = [(i, "w" + " w" * (i % 7), "big" if i % 10 else f"small{i % 3}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mixing_plan(docs, blocks=16).collect()
    assert len(got) == len(rows)
    tokens, taken, weight = Counter(), Counter(), {}
    seen = defaultdict(set)
    for r in got:
        tokens[r.source] += r.n_tokens
        taken[r.source] += r.n_tokens * r.copies
        weight[r.source] = r.weight
        seen[r.source].add(r.copies)
    total = sum(tokens.values())
    assert sum(weight.values()) == pytest.approx(1)
    for s in tokens:
        assert weight[s] * total - 8 <= taken[s] <= weight[s] * total + 1e-6
        assert max(seen[s]) - min(seen[s]) <= 1 and max(seen[s]) <= 5
    order = {}
    for r in got:
        assert len(r.epoch_places) == r.copies and all(0 <= p < 16 for p in r.epoch_places)
        for epoch, place in enumerate(r.epoch_places):  # a permutation: no two blocks of an epoch have one place
            assert order.setdefault((r.source, epoch, place), r.block) == r.block
    first = {(s, b): p for (s, e, p), b in order.items() if e == 0}
    assert any(first.get((s, b)) != p for (s, e, p), b in order.items() if e == 1)
    mixed = Counter(r.doc_id for r in mixing.mix(docs, blocks=16).collect())
    assert mixed == Counter({r.doc_id: r.copies for r in got if r.copies})


def test_tokens_are_those_of_the_tokenizer(spark, cases):
    from parcelspark.llm.tokens import encoder

    want = sorted((r.doc_id or -1, encoder().count(r.text or "")) for r in cases.select("doc_id", "text").collect())
    assert sorted((r.doc_id or -1, r.n_tokens) for r in mixing.mixing_plan(cases).collect()) == want


def test_unlike_texts_of_one_identifier_are_decided_apart(spark):
    rows = [(None if i % 2 else 5, f"text number {i}", "a" if i % 4 else "b") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mixing_plan(docs, blocks=8).collect()
    taken = Counter()
    for r in got:
        taken[r.source] += r.n_tokens * r.copies
    total, weight = sum(r.n_tokens for r in got), {r.source: r.weight for r in got}
    assert all(abs(taken[s] - weight[s] * total) <= 8 for s in weight)


def test_the_plan_equals_one_made_in_a_loop(spark, monkeypatch):
    """Epochs, places and the documents of the last block, recomputed document by document from the hashes alone."""
    from pyspark.sql import functions as F

    from parcelspark.llm.tokens import encoder

    rows = [(i, "w" + " word" * (i * 7 % 23) if i % 11 else "", "big" if i % 5 else f"small{i % 3}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    blocks, seed = 4, 17
    placed = docs.select("doc_id", "source", F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(blocks)).cast("int").alias("b"), F.xxhash64("doc_id", "text", F.lit(seed + 1)).alias("o")).collect()
    count = {i: encoder().count(t) for i, t, _ in rows}
    names = sorted({r.source for r in placed})
    t = np.array([sum(count[r.doc_id] for r in placed if r.source == s) for s in names], float)
    exponent = mixing.choose_exponent(t, 0.98 * np.log(len(names)), 4.0, t.sum())
    weight = mixing.tempered(t, exponent)
    want = {}
    for s, tokens, q in zip(names, t, weight, strict=True):
        own = [r for r in placed if r.source == s]
        epochs, rest = int(t.sum() * q / tokens + 1e-9), 0.0
        rest = t.sum() * q - epochs * tokens
        for e in range(epochs + 1):
            keys = spark.createDataFrame([(s, e, b) for b in sorted({r.b for r in own})], "s string, e int, b int").select("b", F.xxhash64("s", "e", "b", F.lit(seed)).alias("h")).collect()
            room = rest
            for place, k in enumerate(sorted(keys, key=lambda k: (k.h, k.b))):
                inside = sorted((r for r in own if r.b == k.b), key=lambda r: r.o)
                size = sum(count[r.doc_id] for r in inside)
                some = inside if e < epochs or size <= room else []
                if e == epochs and size > room:  # the last block, as far as the room goes
                    used = 0
                    for r in inside:
                        used += count[r.doc_id]
                        if count[r.doc_id] and used <= room:
                            some = [*some, r]
                    room = 0
                room -= size if e == epochs and room else 0
                for r in some:
                    want.setdefault(r.doc_id, []).append(place)
                if e == epochs and room <= 0:
                    break
    for bits in (1, 12):
        monkeypatch.setattr(mixing, "LEAD_BITS", bits)
        got = {r.doc_id: r.epoch_places for r in mixing.mixing_plan(docs, blocks=blocks, seed=seed).collect()}
        assert {i: p for i, p in got.items() if p} == want and len(got) == 900


def test_mixing_cases(cases, empty):
    got = mixing.mixing_plan(cases).collect()
    assert len(got) == 14 and {r.source for r in got} == {"", "s1"}
    assert mixing.mix(cases).columns == cases.columns
    assert mixing.mixing_plan(empty).count() == 0 and mixing.mix(empty).count() == 0
