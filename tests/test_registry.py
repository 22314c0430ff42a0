"""Registered queries against their SQL, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from leafscan.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ALL = sorted(registry.ORACLE_SQL)


def shown(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else repr(value)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return connection


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the given tables")
@pytest.mark.parametrize("name", ALL)
def test_query_equals_sql(spark, duck, name):
    found, wanted = entry.queries()[name](spark, DIR), duck.sql(entry.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    mine = sorted(tuple(shown(r[c]) for c in columns) for r in found.collect())
    order = [wanted.columns.index(c) for c in columns]
    assert mine == sorted(tuple(shown(r[k]) for k in order) for r in wanted.fetchall())


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
