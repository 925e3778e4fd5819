"""Each query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone.plans import oracles
from lodestone.plans.queries import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(one(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    got = queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = [r.asDict() for r in got.collect()]
    if name not in oracles.SQL:
        assert rows
        return
    want = duck.sql(oracles.SQL[name])
    names = want.columns
    want = [dict(zip(names, r, strict=True)) for r in want.fetchall()]
    assert sorted(names) == columns
    assert plain(rows, columns) == plain(want, columns)


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "rank", "chunk_id", "file_path", "start_line", "end_line", "similarity", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
