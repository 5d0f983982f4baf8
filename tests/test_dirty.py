import pytest

from tests.test_oracle import QUERIES

#: One row whatever the input.
TOTALS = {"result_totals", "max_ids", "dictionary_like", "approx_vocab", "total_urls", "link_totals", "federated_totals"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).count() == (3 if name == "word_info" else 1 if name in TOTALS else 0)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nulls_repeats_and_clashing_columns(spark, dirty_dir, name):
    QUERIES[name](spark, dirty_dir).collect()
