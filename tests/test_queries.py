"""Every query of the library with SQL gives the same rows as DuckDB; the others are checked by their own tests."""

import math

import duckdb
import pytest

from tidewatch import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def plain(row):
    out = []
    for v in row:
        if v is not None and not isinstance(v, (str, bool)):
            v = round(float(v), 6) + 0.0
            v = None if math.isnan(v) else v
        out.append(v)
    return repr(tuple(out))


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations", "benchmark"):
        c.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    want = con.execute(SQL[name])
    names = [c[0] for c in want.description]
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(plain, df.select(*names).collect())) == sorted(map(plain, want.fetchall()))


def test_the_others_are_known():
    assert set(QUERIES) - set(SQL) == {"seq_down_sampled", "ml_wallet_clusters", "ml_isolation_forest", "ml_elbow", "ml_average_linkage"}
