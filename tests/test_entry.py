"""Driver contract: entry smoke, every query against its DuckDB oracle at sf0.001."""

import pytest

import __spark_entry__ as E
from tests.oracle_check import compare, duck

SMALL = "/root/testdata/sf0.001"


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 30
    assert {"model", "method", "slice", "n", "tn", "fp", "fn", "tp", "f1"} <= set(df.columns)


def test_every_query_has_oracle_or_reason():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 30


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, con, name):
    info = compare(spark, name, E.queries()[name], E.oracle_sql().get(name), SMALL, con)
    if name in E.oracle_sql():
        assert info["cols"] and info["values"], info
    assert info["rows"] >= 0


SPARK_TO_DUCK = {
    "IntegerType": "INTEGER", "LongType": "BIGINT", "DoubleType": "DOUBLE", "StringType": "VARCHAR",
    "BooleanType": "BOOLEAN", "FloatType": "FLOAT",
}


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_types_match_oracle(spark, con, name):
    df = E.queries()[name](spark, SMALL)
    st = {f.name: SPARK_TO_DUCK.get(type(f.dataType).__name__, type(f.dataType).__name__) for f in df.schema.fields}
    rel = con.sql(E.oracle_sql()[name])
    ot = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert st == ot
