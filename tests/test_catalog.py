"""Every query against its SQL twin in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from crosspanel.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
#: Ten stocks are too few for these to have rows at this size.
MAY_BE_EMPTY = {"select_factors", "high_corr_pairs"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return str(value)[:10] if hasattr(value, "year") else value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    made = [tuple(plain(r[k]) for k in order) for r in found]
    return sorted(made, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    assert got or name in MAY_BE_EMPTY
    if name in catalog.ORACLES:
        cursor = duck.execute(catalog.ORACLES[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        want = rows(columns, cursor.fetchall())
        assert len(got) == len(want)
        for a, b in zip(got, want, strict=True):
            assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-6) for x, y in zip(a, b, strict=True)), (a, b)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["factor", "dt", "n", "ic"] and df.count() > 50


def test_registry():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
