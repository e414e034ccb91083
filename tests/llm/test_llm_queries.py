"""Every query of the subpackage runs; those with SQL give the same rows."""

import pytest

from loomtext.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(name, same):
    same(registry.QUERIES[name], registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(name, spark, data):
    df = registry.QUERIES[name](spark, data)
    assert len(df.columns) == len(set(df.columns)) and df.count() >= 0
