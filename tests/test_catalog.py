"""Every query of the catalog with SQL against DuckDB, on the smallest tables; the others must run."""

import duckdb
import pytest

from prismlake.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()

@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = frame.astype(object).where(frame.notna(), None)
    return sorted(tuple(repr(v.item() if hasattr(v, "item") else v) for v in r) for r in plain.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, con, name):
    got = catalog.queries()[name](spark, DIR).toPandas()
    want = con.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DIR).count() > 0


def test_flagship(spark):
    assert catalog.flagship(spark, DIR).count() == 1
