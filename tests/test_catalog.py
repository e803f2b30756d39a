"""Every query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tidemark import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def settle(rows):
    fix = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(fix(v) for v in r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    names = sorted(df.columns)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == names
    order = [want.columns.index(c) for c in names]
    assert settle([r[c] for c in names] for r in df.collect()) == settle([r[i] for i in order] for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).limit(1).count() == 1
