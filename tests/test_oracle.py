"""Every query of the entity operators against its SQL, on the smallest tables."""

from collections import Counter

import pytest

from tierwise.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = lambda x: round(x, 6) if isinstance(x, float) else x
    return Counter(tuple(str(shown(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL.keys() & QUERIES.keys()))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    cursor = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    assert bag(got.columns, [tuple(r) for r in got.collect()]) == bag(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
