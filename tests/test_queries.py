"""Each core query that has SQL gives on the smallest tables what DuckDB gives for that SQL."""

import glob
import os

import duckdb
import pytest

from quirework.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect(config={"threads": 2})
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def flat(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return str([flat(v) for v in value])
    return value


def rows(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(flat(r[i]) for i in order) for r in records), key=str)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    due = duck.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(due.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(due.fetchall(), due.columns)


def test_the_rest_has_rows(spark):
    for name in registry.QUERIES.keys() - registry.SQL.keys():
        assert registry.QUERIES[name](spark, FOLDER).count() > 0, name
