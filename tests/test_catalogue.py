"""Every query of the engine against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from ledgerloom.plans import catalogue

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def rows(cols, names, data):
    at = [cols.index(n) for n in names]
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(name, spark, sf_dir, con):
    df = catalogue.queries()[name](spark, sf_dir)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    want = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    assert rows(df.columns, names, df.collect()) == rows(want.columns, names, want.fetchall())


def test_entry_imports():
    import __spark_entry__ as e

    assert set(catalogue.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
