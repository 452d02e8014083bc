"""Every query with SQL gives the rows of that SQL; the others give rows."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from triarm.plans import all_queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
QUERIES = all_queries()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(value, 6) + 0.0 if isinstance(value, float) else value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query_equals_sql(spark, duck, sf_dir, name):
    query = QUERIES[name]
    df = query.run(spark, sf_dir)
    found = _rows(df.columns, df.collect())
    relation = duck.sql(query.sql)
    expected = _rows(relation.columns, relation.fetchall())
    assert sorted(df.columns) == sorted(relation.columns)
    assert found == expected
    assert found
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert QUERIES[name].run(spark, sf_dir).collect()


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["num_train", "num_test", "lm_type", "effect", "mean", "se"]
    assert df.count() == 16


def test_contract():
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) >= 85
