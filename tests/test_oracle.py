import pytest

from siftmesh.plans import crawl_catalog, document_catalog, general_catalog, search_catalog, storage_catalog
from tests.conftest import DATA
from tests.oracle import assert_same, connect

CATALOGS = (search_catalog, document_catalog, crawl_catalog, storage_catalog, general_catalog)
QUERIES = {n: f for c in CATALOGS for n, f in c.QUERIES.items()}
SQL = {n: s for c in CATALOGS for n, s in c.SQL.items()}


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, con, name):
    assert_same(QUERIES[name](spark, str(DATA)).toPandas(), con.execute(SQL[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
