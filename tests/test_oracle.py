"""Every registered query against its SQL twin, value by value."""

import os

import duckdb
import pytest

import __spark_entry__ as registry

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


# SQL types beside Spark's names for them
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    result = registry.queries()[name](spark, SF_DIR)
    got = rows_of(result.columns, [tuple(r) for r in result.collect()])
    cursor = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    types = {c[0]: TYPES[str(c[1])] for c in cursor.description}
    expected = rows_of(columns, cursor.fetchall())
    assert sorted(result.columns) == sorted(columns)
    assert len(got) == len(expected)
    assert got and dict(result.dtypes) == types
    differing = [(g, e) for g, e in zip(got, expected) if g != e]
    assert not differing, differing[:3]


def test_every_twin_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
