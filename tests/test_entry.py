import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return tuple(map(_plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, tables, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    sql = entry.oracle_sql()[name]
    got = sorted((tuple(map(_plain, r)) for r in df.select(*cols).collect()), key=repr)
    want = sorted((tuple(map(_plain, r)) for r in tables.sql(f"select {', '.join(cols)} from ({sql})").fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["profile_id", "tag", "place", "final_score"]
