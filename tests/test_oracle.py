"""Every query with SQL against DuckDB on the same tables; the others run and return rows."""

import math
from decimal import Decimal

import duckdb
import pytest
from granary.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return repr(round(float(v), 9) + 0.0) if isinstance(v, float | Decimal) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, small, duck, name):
    df = catalog.QUERIES[name](spark, small)
    names = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in names] for r in df.collect()), key=str)
    found = duck.execute(catalog.SQL[name])
    at = {d[0]: i for i, d in enumerate(found.description)}
    assert sorted(at) == names
    assert {c: KINDS[t] for c, t in df.dtypes} == {d[0]: str(d[1]) for d in found.description}
    assert got == sorted(([plain(r[at[c]]) for c in names] for r in found.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_returns_rows(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
