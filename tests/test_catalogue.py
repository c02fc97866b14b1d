"""Every query against its SQL, run by DuckDB on the same tables."""

import os

import duckdb
import pytest

from quire.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 5) if isinstance(v, float) else v if v is None or isinstance(v, (bool, int, str)) else str(v)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in catalogue.oracle_sql():
        assert got
        return
    res = duck.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)


def test_every_query_has_its_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())
