"""Every query of the library against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import pytest

from gleaner.plans import catalog, feeds  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(SF)):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{float(v):.6g}" if not isinstance(v, (str, bool)) and isinstance(float(v), float) else str(v)

    return sorted(tuple(value(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canon(got, df.columns) == canon(want.fetchall(), want.columns)


def test_contract():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
