import math

import numpy as np
import pytest

from parcelspark.llm import nearest

ASKED = "vec_id % 20 = 0"


def table(spark, rows, kind="float"):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], "x", 1.0) for i, v in rows]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, v string, score double").repartition(3)


def usable(v, d):
    return v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v) and any(v)


def brute(rows, d, k=20, kind=np.float32):
    """The k nearest of each query: an identifier with several vectors counts with its largest products."""
    rows = [(i, np.array(v, kind).astype(float)) for i, v in rows if i is not None and usable(v, d)]
    out = {}
    for q in {i for i, _ in rows if i % 20 == 0}:
        best = {}
        for a in (v for i, v in rows if i == q):
            for i, v in rows:
                if i != q:
                    best[i] = max(best.get(i, -np.inf), float((a * v).sum()))
        out[q] = sorted(((-s, i) for i, s in best.items()))[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    hits = sum(len({i for _, i in got.get(q, [])} & {i for _, i in w}) for q, w in want.items())
    return hits / max(1, sum(map(len, want.values())))


def cases(rng, n=300, d=6):
    """Common vectors, repeated rows and identifiers, and every kind of vector that takes no part."""
    rows = [(int(i), rng.standard_normal(d).round(3).tolist()) for i in rng.permutation(n)]
    same = rng.standard_normal(d).round(3).tolist()
    rows += [(1000 + i, same) for i in range(n)] + [(40, rows[0][1]), (40, same), (60, same), (60, same), (61, [-0.0] + same[1:]), (62, [0.0] + same[1:])]
    rows += [(None, same), (2001, None), (2002, []), (2003, [0.0] * d), (2004, [None] * d), (2005, [math.nan] * d), (2006, [math.inf] * d), (2007, same + [1.0]), (2020, [0.0] * d), (2040, [None] + same[1:])]
    return rows


@pytest.mark.parametrize("kind", ["float", "double"])
def test_small_tables_are_exact(spark, kind):
    """One leaf, small blocks: every candidate within the error is compared exactly, ties go to the smaller identifier."""
    rows = cases(np.random.default_rng(3))
    got = found(nearest.nearest(table(spark, rows, kind), ASKED, block=64, chunk=8))
    want = brute(rows, 6, kind=np.float32 if kind == "float" else float)
    assert got.keys() == want.keys() and recall(got, want) > 0.99
    for q, w in want.items():
        if {i for _, i in got[q]} == {i for _, i in w}:
            assert [i for _, i in got[q]] == [i for _, i in w] and [s for s, _ in got[q]] == pytest.approx([s for s, _ in w], abs=1e-12)


@pytest.mark.parametrize("spread", [0.05, 10.0])
def test_recall_over_many_leaves(spark, spread):
    """Clustered vectors of many lengths, and vectors without clusters."""
    rng = np.random.default_rng(int(spread))
    n, d = 3000, 24
    centres = rng.standard_normal((30, d))
    x = centres[rng.integers(0, 30, n)] + spread * rng.standard_normal((n, d))
    x *= rng.uniform(0.5, 2, (n, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = found(nearest.nearest(table(spark, rows), ASKED, leaf_rows=150, block=128, chunk=32)), brute(rows, d)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values()) and recall(got, want) >= 0.9


def test_a_third_of_near_copies(spark):
    """Entries whose codes are equal are told apart by exact products, however many they are."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal(16)
    x = np.concatenate([base + 1e-4 * rng.standard_normal((700, 16)), rng.standard_normal((1400, 16))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = found(nearest.nearest(table(spark, rows, "double"), ASKED, leaf_rows=200, block=100)), brute(rows, 16, kind=float)
    assert recall(got, want) >= 0.9


def test_few_candidates_and_empty_tables(spark):
    rows = [(0, [1.0]), (3, [2.0]), (20, [-1.0]), (7, [2.0])]
    got = found(nearest.nearest(table(spark, rows), ASKED))
    assert got == {0: [(-2.0, 3), (-2.0, 7), (1.0, 20)], 20: [(1.0, 0), (2.0, 3), (2.0, 7)]}
    assert nearest.nearest(table(spark, rows[:1]), ASKED).count() == 0
    assert nearest.nearest(table(spark, rows[1:2]), ASKED).count() == 0
    empty = nearest.nearest(table(spark, rows).where("false"), ASKED)
    assert empty.count() == 0 and empty.columns == ["query_id", "rank", "vec_id", "score"]


def test_the_parallel_error_is_penalised():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 32))
    parts = nearest._parts(x, np.zeros_like(x), 32)
    words = nearest._words(*parts, 0.0, rng)
    plain, plain_loss, plain_off = nearest.choose(*parts, words, 0.0)
    code, loss, off = nearest.choose(*parts, words, 2.0)
    assert (loss <= plain_loss + 2.0 * plain_off**2 + 1e-9).all() and np.mean(off**2) < 0.5 * np.mean(plain_off**2)
    x_hat = words[np.arange(16), code].reshape(4000, -1)
    lost, unit = x - x_hat, x / np.linalg.norm(x, axis=1, keepdims=True)
    assert loss == pytest.approx((lost**2).sum(1) + 2.0 * (lost * unit).sum(1) ** 2)


def test_table_sums_are_products_with_the_decoded_vectors():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((900, 10)), rng.standard_normal((5, 10))
    index = nearest.fit(x, 900, 5, leaf_rows=300)
    leaf = index.leaves(x)
    codes = index.encode(x, leaf)
    table, unit = index.tables(q)
    total = sum(table[:, p].astype(float)[:, codes[:, p]] for p in range(codes.shape[1])) * unit[:, None]
    want = q @ (index.decode(codes, leaf) - index.centres[leaf]).T
    shift = want - total
    assert np.abs(shift - shift.mean(1, keepdims=True)).max() < codes.shape[1] * 1.01 * unit.max()
