import pytest

from siftmesh.llm import catalog
from tests.conftest import DATA
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_its_sql(spark, con, name):
    assert_same(catalog.QUERIES[name](spark, str(DATA)).toPandas(), con.execute(catalog.SQL[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, str(DATA)).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert catalog.QUERIES[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_nulls_repeats_and_clashing_columns(spark, dirty_dir, name):
    catalog.QUERIES[name](spark, dirty_dir).collect()
