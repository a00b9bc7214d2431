import pytest

import __spark_entry__
from chatloom.plans import catalog, catalog_answers, catalog_commands, catalog_gates, catalog_hierarchy, catalog_more, catalog_search, catalog_vectors  # noqa: F401
from tests.compare import same_rows


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, sf, name):
    same_rows(spark, catalog.queries()[name], catalog.oracle_sql()[name], sf)


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_of_the_engine_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
