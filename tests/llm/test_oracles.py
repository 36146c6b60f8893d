"""Queries that have SQL against it."""

import pytest
from compare import connect, difference

from broadsheet.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, name, sf_dir):
    assert difference(registry.queries()[name](spark, sf_dir), connect(sf_dir), registry.oracle_sql()[name]) is None
