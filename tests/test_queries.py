"""Every registered parcel query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from parcelspark import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_equals_sql(spark, db, name):
    df = plans.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = db.execute(plans.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert len(got) == len(want)
    assert all(a == pytest.approx(b, abs=2e-5) if all(isinstance(x, float) for x in a) else a == b for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("name", ["sample_n", "sample_per_group"])
def test_rows(spark, name):
    assert plans.queries()[name](spark, DATA).count() > 0
