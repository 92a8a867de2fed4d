"""Every registered query against its DuckDB twin on the smallest data folder."""

from pathlib import Path

import compare
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    got = compare.rowset(df.columns, df.collect())
    assert got
    if name not in ORACLES:
        return
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == compare.rowset(columns, cur.fetchall())


def test_entry(spark):
    assert len(entry.entry(spark).collect()) == 10
