"""Stupid-backoff scores against SQL and brute force."""

import math
import random
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from parcelspark.llm import lm_scores


def texts(seed, n=60):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(12)))) for i in range(n)] + [(70, None), (71, " \t"), (72, "zz"), (73, "zz a")]


def grams(t, n):
    w = (t or "").split()
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


def brute(corpus, t, order, backoff=0.4):
    count = Counter(g for _, x in corpus for k in range(1, order + 1) for g in grams(x, k))
    total, w = sum(len((x or "").split()) for _, x in corpus), (t or "").split()

    def s(g):
        if len(g) == 1:
            return (count[g] or 0.5) / total
        return count[g] / count[g[:-1]] if count[g] else backoff * s(g[1:])

    return len(w), sum(math.log(s(tuple(w[max(0, i - order + 1) : i + 1]))) for i in range(len(w))) if w else None


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_scores_equal_sql(spark):
    rows = texts(9)
    got = {r.doc_id: (r.n_words, r.log_score) for r in lm_scores.lm_scores(frame(spark, rows), slices=3).collect()}
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    want = {r[0]: (r[1], r[2]) for r in con.execute(lm_scores.SQL).fetchall()}
    assert set(got) == set(want)
    for k, (n, z) in want.items():
        assert got[k][0] == n and (got[k][1] == pytest.approx(z, abs=1e-3) if n else got[k][1] is None)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_brute_force(spark, order):
    rows = texts(order)
    for r in lm_scores.lm_scores(frame(spark, rows), order=order, slices=2).collect():
        n, z = brute(rows, dict(rows)[r.doc_id], order)
        assert r.n_words == n and (r.log_score == pytest.approx(z) if n else r.log_score is None)


@pytest.mark.parametrize("order", [1, 3])
def test_other_texts_back_off(spark, order):
    corpus, other = texts(1, 15), [(i, t) for i, t in texts(2)] + [(90, "never seen words a b"), (90, "a b c"), (None, "a b")]
    got = sorted((r.doc_id or -1, r.n_words, round(r.log_score or 0, 6)) for r in lm_scores.score_against(frame(spark, other), frame(spark, corpus), order).collect())
    assert got == sorted((i or -1, brute(corpus, t, order)[0], round(brute(corpus, t, order)[1] or 0, 6)) for i, t in other)


def test_repeated_and_null_identifiers(spark, cases, empty):
    rows = [(1, "a b c d"), (7, "a b c d"), (7, "a b x y z"), (7, "a b x y z"), (None, "q r s"), (None, "a"), (None, None), (2**62 + 5, "a b c")]
    got = sorted((repr(r.doc_id), r.n_words, round(r.log_score or 0, 6)) for r in lm_scores.lm_scores(frame(spark, rows)).collect())
    assert got == sorted((repr(i), brute(rows, t, 3)[0], round(brute(rows, t, 3)[1] or 0, 6)) for i, t in rows)
    assert lm_scores.lm_scores(cases).count() == 14
    assert lm_scores.lm_scores(empty).count() == 0


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_ngrams_are_exchanged_once(spark, order):
    """Counts and the rows that take them come from one exchange; n-grams that occur once go no further."""
    rows = [(i, t) for i, t in texts(order) if t and t.split()]
    keys = spark.createDataFrame(rows, "key long, text string").repartition(4)
    found = lm_scores.with_counts(lm_scores.signed_rows(keys, order, 0, 1, lm_scores.short_grams(keys, order)))
    got = found.collect()
    final = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("MapInArrow") == 1 and "ReusedExchange" in final
    count = Counter(g for _, t in rows for k in range(1, order + 1) for g in grams(t, k))
    # one n-gram of each document, with its count or without one, has its number of words
    first = {i: count[tuple(t.split()[: min(order, len(t.split()))])] for i, t in rows}
    assert {r.key: (r.n or 1, r.code - 2) for r in got if r.code >= 2} == {i: (first[i], len(t.split())) for i, t in rows}
    assert all(r.n > 1 for r in got if r.code < 2)
    plus = Counter(i for i, t in rows for g in grams(t, order) if count[g] > 1)
    ones = Counter()
    for r in got:
        if (r.code == 1 or r.code >= 2 and r.n) and len(dict(rows)[r.key].split()) >= order:
            ones[r.key] += r.times
    assert ones == plus


def test_common_ngrams_have_one_row_of_a_document(spark):
    """A pair of words that fills texts goes to one task as a row of each text and sign."""
    rows = [(i, "a b " * (100 + i) + f"w{i}") for i in range(30)]
    keys = spark.createDataFrame(rows, "key long, text string").coalesce(1)
    signed = lm_scores.signed_rows(keys, 3, 0, 1, lm_scores.short_grams(keys, 3))
    most = signed.groupBy("hash", "key", "code").count().agg({"count": "max"}).first()[0]
    assert most == 1 and signed.count() < 30 * 12
    for r in lm_scores.lm_scores(frame(spark, rows)).collect():
        n, z = brute(rows, dict(rows)[r.doc_id], 3)
        assert r.n_words == n and r.log_score == pytest.approx(z)
