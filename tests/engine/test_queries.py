"""Every query of the library against its SQL, on the smallest tables; those without SQL at least run and have rows."""

import datetime
import glob
import os

import duckdb
import pytest

from tidemark import registry

SF = "/root/testdata/sf0.001"
MAY_BE_EMPTY = {"learned_values", "hybrid_topk"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p).split('.')[0]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(v.replace(tzinfo=None)) if isinstance(v, datetime.datetime) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted([tuple(plain(r[i]) for i in order) for r in rows])


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got or name in MAY_BE_EMPTY
        return
    want = duck.sql(sql)
    assert rows_of(df.columns, got) == rows_of(want.columns, want.fetchall())
