"""Queries against their SQL on rows that only larger tables have."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from parcelspark import plans
from parcelspark.functions import crs


def orders(folder, keys, prices, cust=0):
    n = len(keys)
    pq.write_table(pa.table({"o_orderkey": pa.array(keys, pa.int64()), "o_custkey": pa.array([cust] * n, pa.int64()), "o_totalprice": pa.array(prices, pa.float64())}), f"{folder}/orders.parquet")


def both(spark, folder, name):
    """Rows of the query and of its SQL, columns in the SQL's order."""
    con = duckdb.connect()
    for f in folder.iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    cur = con.execute(plans.oracle_sql()[name])
    cols = [x[0] for x in cur.description]
    return sorted(tuple(r[c] for c in cols) for r in plans.queries()[name](spark, str(folder)).collect()), sorted(cur.fetchall())


def test_cells_over_the_pole(spark, tmp_path):
    """Rows at the pole, past it, past the equator again and after a whole turn (F6)."""
    rows = [0, 6099, 6100, 6101, 9000, 15_100, 20_000, 30_000, 36_000, 540_000]
    orders(tmp_path, [r * 100 for r in rows], [1000.0] * len(rows))
    got, want = both(spark, tmp_path, "geodesic_cells")
    assert got == want and {r[0] for r in got} == set(rows) and any(r[2] < 0 for r in got)


def test_length_over_the_pole(spark):
    one = spark.createDataFrame([(89.9, 90.1)], "a double, b double")
    there = crs.geodesic(F.lit(10.0), F.col("a"), F.lit(10.0), F.col("b"))
    same = crs.geodesic(F.lit(10.0), F.col("a"), F.lit(190.0), 180 - F.col("b"))
    a, b = one.select(there, same).first()
    assert a == pytest.approx(b) == pytest.approx(22_338.8, abs=1)


def test_equal_slopes_of_actions(spark, tmp_path):
    """Sixty blocks whose steepest slopes differ by rounding alone: of equals the smaller blocks (F7)."""
    prices = [(59_000 if i < 50 else 10) * 35.0 + 34.99 for i in range(60)]
    assert len({p - p // 35 * 35 for p in prices}) > 1
    orders(tmp_path, [i * 1000 for i in range(60)], prices)
    got, want = both(spark, tmp_path, "topk_actions")
    assert got == want and [r[0] for r in got] == [i * 10 for i in range(50)]
