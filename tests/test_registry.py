"""Each registered query against its SQL, and the registry itself."""

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    spark.catalog.clearCache()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (d[cols].sort_values(cols).reset_index(drop=True) for d in (got, want))
    assert len(a) == len(b) and len(a) > 0
    for c in cols:
        assert (a[c] == b[c]).all(), c


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
