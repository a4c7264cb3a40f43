"""Every registered query against the SQL it must agree with, on the same whole tables."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import pytest

from catalogue.oracle import ORACLES
from catalogue.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

# Spark type to the DuckDB type it must come out as.
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "float": "FLOAT",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "decimal(38,0)": "DECIMAL(38,0)",
}


@pytest.fixture(scope="session")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def value(x):
    if isinstance(x, (list, tuple)):
        return tuple(value(v) for v in x)
    if isinstance(x, float) and math.isnan(x):
        return "nan"
    return x


def duck_type(spark_type: str) -> str:
    if spark_type.startswith("array<"):
        return duck_type(spark_type[6:-1]) + "[]"
    return TYPES[spark_type]


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    expected = duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    kinds = dict(zip(expected.columns, map(str, expected.types)))
    assert {c: duck_type(t) for c, t in df.dtypes} == kinds
    ours = Counter(tuple(value(row[c]) for c in columns) for row in df.collect())
    picked = [expected.columns.index(c) for c in columns]
    theirs = Counter(tuple(value(row[i]) for i in picked) for row in expected.fetchall())
    assert sum(theirs.values()) > 0
    assert ours == theirs
