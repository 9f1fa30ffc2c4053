"""Every query with SQL gives what DuckDB gives."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from millwatch.plans import detection, linking, texts

SF = "/root/testdata/sf0.01"
SQL = detection.SQL | texts.SQL | linking.SQL


def plain(v):
    if v is None or isinstance(v, str | bool):
        return v
    if isinstance(v, int | float):
        return None if math.isnan(v) else round(float(v), 5)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["run_id", "t_event_s", "t_start_s", "t_end_s", "score"]


def test_sql_belongs_to_queries():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
