"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from tidemark.plans.oracle import ORACLE
from tidemark.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def clean(v):
        return None if isinstance(v, float) and math.isnan(v) else v

    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLE) <= set(entry_points.oracle_sql())


def test_no_machine_local_folders():
    for path in glob.glob("tidemark/**/*.py", recursive=True):
        with open(path) as source:
            assert "tempfile" not in source.read(), path


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, tables, name):
    frame = QUERIES[name](spark, SMALL)
    want = tables.sql(ORACLE[name])
    assert sorted(frame.columns) == sorted(want.columns)
    rows = by_name(want.columns, want.fetchall())
    assert by_name(frame.columns, frame.collect()) == rows
    assert rows


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["index_date", "hr", "cnt"]
