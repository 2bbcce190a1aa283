"""Every registered query against its DuckDB twin."""

import pytest

from benchloom import registry

from .util import assert_twin

registry.load()
D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_twin(spark, name):
    assert_twin(registry.QUERIES[name](spark, D), registry.ORACLE_SQL[name], D)


def test_flagship_and_names():
    assert registry.FLAGSHIP in registry.QUERIES and set(registry.ORACLE_SQL) <= set(registry.QUERIES)
