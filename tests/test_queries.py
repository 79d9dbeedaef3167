"""Every query with an oracle gives the rows of its SQL on the smallest tables."""

import math

import duckdb
import pytest

from strataforge.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 4) + 0.0
    return v if isinstance(v, (int, str, bool)) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    cursor = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()]
    rows = [tuple(plain(r[c]) for c in columns) for r in got.collect()]
    assert sorted(names) == columns
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
