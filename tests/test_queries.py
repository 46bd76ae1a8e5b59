"""Every registered query of the library against its SQL."""

import pytest
from oracle import SMALLEST, assert_same

from graphloom import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    assert_same(spark, SMALLEST, registry.QUERIES[name], registry.ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
