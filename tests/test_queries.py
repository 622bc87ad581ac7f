"""Every registered query with SQL gives DuckDB's rows on the small tables; none is empty."""

import os

import duckdb
import pytest

from webloom.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(found):
    return sorted((tuple(r) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("pages", "events"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    own = rows(got.select(*columns).collect())
    assert own
    if name in registry.ORACLE_SQL:
        want = duck.sql(registry.ORACLE_SQL[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert own == rows([r[i] for i in at] for r in want.fetchall())
