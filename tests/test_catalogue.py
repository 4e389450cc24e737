"""Every query against its SQL; those without SQL must run and give rows."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cpgspark.catalogue import load  # noqa: E402
from tools.compare import compare, connect  # noqa: E402

QUERIES, SQL = load()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    cursor = duck.execute(SQL[name])
    expected = cursor.fetchall()
    assert compare(df.columns, rows, [d[0] for d in cursor.description], expected) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, sf):
    df = QUERIES[name](spark, sf)
    assert df.columns
    assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
