import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import queries as core

NAMES = list(core.QUERIES)


def plain(v):
    import decimal
    import math

    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert core.QUERIES.keys() <= entry.queries().keys()


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_against_sql(spark, data, name):
    df = core.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*cols).collect())
    if name in core.SQL:
        con = duckdb.connect()
        for f in os.listdir(data):
            con.sql(f"CREATE VIEW {f.split('.')[0]} AS FROM '{data}/{f}'")
        rel = con.sql(core.SQL[name])
        assert sorted(rel.columns) == cols
        rows = con.sql("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({core.SQL[name]})").fetchall()
        assert got == sorted(repr(tuple(map(plain, r))) for r in rows)
