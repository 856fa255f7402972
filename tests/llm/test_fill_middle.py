import hashlib
import random
import re

from parcelspark.llm import fill_middle

MARKS = re.compile("<[PSM]>")


def brute(doc_id, text, salt="1:"):
    """The contract, one row at a time."""
    text = text or ""
    d = hashlib.sha256(f"{salt}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or MARKS.search(text) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in texts], "doc_id long, text string, h1 string, form string").repartition(2)


def check(df, texts):
    out = fill_middle.fill_in_middle(df)
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted(map(tuple, out.collect()), key=key) == sorted((brute(i, t) for i, t in texts), key=key)
    back = out.select("doc_id", fill_middle.restore(out["output"], out["form"]).alias("text"))
    assert sorted((r[0] or 0, r[1]) for r in back.collect()) == sorted((i or 0, t or "") for i, t in texts)


def test_equals_brute_force(spark):
    rnd = random.Random(5)
    alphabet = ["a", "Bc", " ", "\n", "1", "é", "漢", "👍", "<", ">", "<P", "P>", "S>", "<M>", "\u0000", "'"]
    texts = [(i, "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(12)))) for i in range(1500)]
    texts += [(5000 + i, "".join(rnd.choice(alphabet[:8]) for _ in range(rnd.randrange(400)))) for i in range(300)]
    check(rows(spark, texts), texts)


def test_cases_and_very_long_texts(spark, cases, empty):
    texts = [(r.doc_id, r.text) for r in cases.select("doc_id", "text").collect()]
    texts += [(20, "é" * 1_500_000), (21, "ab " * 1_000_000), (22, "x" * 5_000_000), (23, "<P"), (24, None), (None, None)]
    check(rows(spark, texts), texts)
    assert fill_middle.fill_in_middle(cases).count() == cases.count()
    assert fill_middle.digests(fill_middle.fill_in_middle(empty)).count() == 0


def test_forms_take_their_shares(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "'some plain words' AS text")
    got = {r.form: r["count"] for r in fill_middle.fill_in_middle(df, plain=50, suffix_first=50).groupBy("form").count().collect()}
    assert abs(got["plain"] - 2000) < 200 and abs(got["spm"] - got["psm"]) < 200


def test_digests(spark):
    df = spark.createDataFrame([(i, "a few words, and more") for i in range(30)], "doc_id long, text string")
    for r in fill_middle.digests(fill_middle.fill_in_middle(df)).collect():
        assert r.restored_sha256 == hashlib.sha256(b"a few words, and more").hexdigest()
        assert r.output_sha256 == hashlib.sha256(brute(r.doc_id, "a few words, and more")[5].encode()).hexdigest()
