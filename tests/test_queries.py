"""Every query that has SQL gives its rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CHECKED = sorted(n for n in entry.oracle_sql() if not n.startswith("op"))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    return con


def _plain(rows, columns):
    fix = lambda v: None if v is None else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(fix(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    assert sorted(got.columns) == sorted(names)
    assert _plain(got.collect(), sorted(names)) == _plain(want, sorted(names))


def test_entry(spark):
    assert entry.entry(spark).count() == 200
