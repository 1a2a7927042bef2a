import os

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the tables aren't there")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SMALL):
        path = f"{SMALL}/{name}"
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


def test_the_flagship_query(spark):
    assert len(entry.entry(spark).collect()) == 10


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_each_query_against_its_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SMALL).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_a_query_without_sql_runs(spark):
    assert entry.queries()["phrase_slop_freqs"](spark, SMALL).count() > 0
