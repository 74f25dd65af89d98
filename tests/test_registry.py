"""Every registered query of the library against its SQL."""

import pytest
from oracle import DATA, duck_rows, spark_rows

from tessera.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    names, rows = spark_rows(registry.QUERIES[name](spark, DATA))
    if name in registry.ORACLES:
        assert (names, rows) == duck_rows(registry.ORACLES[name])
    else:
        assert len(set(names)) == len(names)


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
