"""Each query against its SQL in DuckDB, over the small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tidemark.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or hasattr(value, "as_tuple"):
        return round(float(value), 6)
    return str(value)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in sorted(Path(DATA).glob("*.parquet")):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    ours = sorted([tuple(plain(r[c]) for c in columns) for r in frame.collect()], key=repr)
    result = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    theirs = sorted([tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()], key=repr)
    assert ours == theirs


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
