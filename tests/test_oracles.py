"""Every query with a SQL twin gives the twin's rows on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from panelforge.jobs.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    return None if x is None or x is pd.NaT or isinstance(x, float) and math.isnan(x) else x


def close(a, b):
    if isinstance(a, float) and isinstance(b, (float, int)):
        return math.isclose(a, b, rel_tol=1e-7, abs_tol=2e-5)
    return a == b


def keyed(rows, columns):
    """Rows sorted by all but their doubles first, so that a last digit cannot change the order."""
    def key(row):
        return [(x is None, str(x)) for x in row if not isinstance(x, float)] + [(round(x, 3),) for x in row if isinstance(x, float)]

    return sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=key)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = [r.asDict() for r in df.collect()]
    ran = db.execute(ORACLES[name])
    names = [d[0] for d in ran.description]
    want = [dict(zip(names, r)) for r in ran.fetchall()]
    columns = sorted(names)
    assert columns == sorted(df.columns)
    assert len(got) == len(want)
    for a, b in zip(keyed(got, columns), keyed(want, columns)):
        assert all(close(x, y) for x, y in zip(a, b)), (a, b)
