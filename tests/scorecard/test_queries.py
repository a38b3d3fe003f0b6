"""Every query with SQL gives the rows of its SQL in DuckDB; the others run."""

import math
import warnings

import duckdb
import pytest

from tallymark.plans import catalog

TABLES = ["lineitem", "orders"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    own = [tuple(plain(v) for v in r) for r in df.select(*columns).collect()]
    assert own
    if name in catalog.ORACLE_SQL:
        found = duck.execute(catalog.ORACLE_SQL[name])
        at = {d[0]: i for i, d in enumerate(found.description)}
        assert sorted(at) == columns
        want = [tuple(plain(r[at[c]]) for c in columns) for r in found.fetchall()]
        key = lambda r: tuple((v is None, str(v)) for v in r)
        assert sorted(own, key=key) == sorted(want, key=key)
