"""Every registered query with SQL gives the rows of its SQL in DuckDB, at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(k for k in __spark_entry__.oracle_sql() if not k.startswith("op")))
def test_query_equals_its_sql(spark, con, name):
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cur = con.execute(__spark_entry__.oracle_sql()[name])
    there = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    assert sorted(there) == columns
    assert {c: KINDS[t] for c, t in df.dtypes} == kinds
    theirs = sorted((tuple(plain(r[there.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(k for k in __spark_entry__.queries() if k not in __spark_entry__.oracle_sql() and not k.startswith("op") and k != "pipeline"))
def test_query_without_sql_runs(spark, name):
    assert __spark_entry__.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() == 5000 and "unit_score" in df.columns
