"""Each registered panel query against its SQL in DuckDB, on the small tables."""

import math
import os

import duckdb
import pytest

from meterloom.operators import models as M
from meterloom.plans.queries import SQL, Q

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def close(a, b):
    if a is None or b is None:
        return a is b
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = Q[name](spark, DIR)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in at) for r in cur.fetchall()]
    order = lambda r: tuple(str(v) if not isinstance(v, float) else "" for v in r) + tuple(v if isinstance(v, float) else 0.0 for v in r)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=order), sorted(want, key=order)):
        assert all(close(x, y) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_query_without_sql_runs(spark, monkeypatch, name):
    """Values are held against other computations in test_fitting, test_more_queries and test_whole_queries."""
    monkeypatch.setattr(M.Network.__init__, "__defaults__", (3, 0.03, 15, 0))  # a few passes
    df = Q[name](spark, DIR)
    assert len(df.head(1)) == 1
