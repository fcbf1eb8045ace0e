"""The operators' queries that SQL can express, against that SQL."""

import pytest

from cueflow.llm import queries
from tests.conftest import same_as_sql


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    same_as_sql(spark, queries.QUERIES[name], queries.ORACLE[name], sf_dir)
