import math

import pytest

import __spark_entry__ as entry
from inkmill.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "pages")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted(repr([clean(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = catalog.queries()[name](spark, DATA)
    want = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
