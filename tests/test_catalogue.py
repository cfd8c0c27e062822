"""Registered queries against their SQL in DuckDB, on the smallest data."""

import math
import os

import pytest

from bagwright.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


def plain(rows, order):
    def value(v):
        return round(v, 3) if isinstance(v, float) and not math.isnan(v) else str(v) if v is not None and not isinstance(v, (int, str)) else v

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    cursor = duck.execute(catalogue.ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = plain(cursor.fetchall(), [columns.index(c) for c in sorted(columns)])
    assert plain([tuple(r) for r in df.collect()], [df.columns.index(c) for c in sorted(df.columns)]) == want


def test_splits_have_rows_on_both_sides(spark):
    made = {n: catalogue.QUERIES[n](spark, DIR) for n in ("split_even", "split_odd", "nested_split_remainder", "split_bind_identity", "split_safe_pipeline")}
    assert made["split_even"].count() and made["split_odd"].count()
    assert {r.bucket for r in made["nested_split_remainder"].select("bucket").distinct().collect()} == set("abcd")
    for n in ("split_bind_identity", "split_safe_pipeline"):
        assert "Union" in made[n]._jdf.queryExecution().analyzed().toString()
        # Halves of the union, each with rows: two filters by a remainder.
        assert made[n]._jdf.queryExecution().analyzed().toString().count("pmod(l_orderkey") >= 2


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["l_orderkey", "l_returnflag", "revenue", "n"]
    assert set(e.oracle_sql()) <= set(e.queries())
