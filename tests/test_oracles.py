"""Every bound query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tripweave import queries as bound

bound.load_all()
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def ordered(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def same(x, y):
    if x is None or y is None:
        return x is y
    if isinstance(x, float) or isinstance(y, float):
        return math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)
    return x == y


@pytest.mark.parametrize("name", sorted(bound.ORACLES))
def test_matches_sql(spark, data, duck, name):
    df = bound.QUERIES[name](spark, data)
    cur = duck.execute(bound.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = ordered([tuple(r) for r in df.collect()], df.columns), ordered(cur.fetchall(), columns)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(same(x, y) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(bound.QUERIES) - set(bound.ORACLES)))
def test_runs_without_sql(spark, data, name):
    assert bound.QUERIES[name](spark, data).count() > 0


def test_coverage_table_is_complete():
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    text = open(os.path.join(here, "COVERAGE.md")).read()
    for name in bound.QUERIES:
        assert f"`{name}`" in text
