"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import os
import re

import pytest

import __spark_entry__ as entry

ORACLE = {k: v for k, v in entry.oracle_sql().items() if not re.match(r"op\d|pipeline", k)}


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(data):
        if name.endswith(".parquet"):
            con.execute(f"create view {name[:-8]} as select * from '{data}/{name}'")
    return con


def listed(frame):
    columns = sorted(frame.columns)
    return sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, data, duck, name):
    ours, sql = entry.queries()[name](spark, data).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(sql.columns)
    assert listed(ours) == listed(sql)


def test_every_query_here_has_sql():
    assert {k for k in entry.queries() if not re.match(r"op\d|pipeline", k)} == set(ORACLE)


def test_entry(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() == 30
