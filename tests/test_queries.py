"""Every query of the analytics part runs on the smallest tables; those with SQL agree with it."""

import os

import duckdb
import pytest

from tallyscope.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{small}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return str(value)
    return str(round(float(value), 8) + 0.0)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, small, duck, name):
    df = catalog.queries()[name](spark, small)
    rows = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name in catalog.oracle_sql():
        got = duck.execute(catalog.oracle_sql()[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == sorted(df.columns)
        order = sorted(range(len(names)), key=lambda i: names[i])
        assert sorted(rows) == sorted(tuple(plain(r[i]) for i in order) for r in got.fetchall())
    else:
        assert rows
