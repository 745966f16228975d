"""Every catalogue query runs at the smallest size, and those with SQL give DuckDB's rows."""

import os

import duckdb
import pytest

from phrasewright.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(str, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, FOLDER).toPandas()
    if name in catalogue.oracle_sql():
        want = duck.execute(catalogue.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert _rows(got) == _rows(want)
    else:
        assert len(got)
