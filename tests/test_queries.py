"""Every query runs on the smallest tables, and equals its SQL."""

import glob
import os

import duckdb
import pytest

from verbatrix.plans import changes_queries, queries, store_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ALL = {**changes_queries.QUERIES, **queries.QUERIES, **store_queries.QUERIES}
SQL = {**changes_queries.SQL, **queries.SQL, **store_queries.SQL}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(round(float(r[i]), 5)) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(ALL))
def test_query(spark, duck, name):
    df = ALL[name](spark, SF)
    got = df.collect()
    if name in SQL:
        cur = duck.execute(SQL[name])
        names = [x[0] for x in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert plain(got, df.columns) == plain(cur.fetchall(), names)
