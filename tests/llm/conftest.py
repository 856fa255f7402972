import pytest

#: doc_id, text: nulls, empties, ties, repeated rows, long and multi-byte texts
CASES = [
    (1, "a b c d e f g"),
    (2, "a  b\tc d\ne f g"),
    (3, None),
    (4, ""),
    (5, "word"),
    (6, "word"),
    (6, "word"),
    (7, "   "),
    (None, "a b c d e f g"),
    (8, "é€ 漢字 👍 " * 40),
    (9, "long words " * 30_000),
    (10, "x" * 5000),
    (11, "the quick brown fox jumps over the lazy dog and runs away from it " * 3),
    (12, "the quick brown fox jumps over the lazy dog and runs away from it " * 3),
]
EXTRA = "digest string, rep string, block string, copies string, weight string, spans string, score string, keep_id string"


@pytest.fixture(scope="session")
def cases(spark):
    """Edge cases with columns whose names the operators use inside."""
    rows = [(i, t, "en", "s1" if (i or 0) % 3 else None, len(t or ""), *["x"] * 8) for i, t in CASES]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


@pytest.fixture(scope="session")
def empty(cases):
    return cases.where("false")
