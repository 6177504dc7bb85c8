"""Every cleaning query that has SQL, against that SQL in another engine."""

import os

import duckdb
import pytest

from refinery import queries as Q

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_oracle(spark, oracle, name):
    df = Q.QUERIES[name](spark, SF)
    found = oracle.sql(Q.ORACLE_SQL[name])
    names = sorted(df.columns)
    assert names == sorted(found.columns)
    at = [found.columns.index(n) for n in names]
    assert ordered(tuple(r) for r in df.select(names).collect()) == ordered(tuple(r[i] for i in at) for r in found.fetchall())


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
