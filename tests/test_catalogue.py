"""Every query of the catalogue against its SQL on the same tables."""

import pytest

from cueflow.plans import catalogue
from tests.conftest import same_as_sql


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    same_as_sql(spark, catalogue.QUERIES[name], catalogue.SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0
