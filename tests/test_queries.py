"""Every registered query of the reference's operators against its SQL."""

import pytest

from quire.plans import registry
from tests.util import same_rows


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(name, spark, sf_dir, duck):
    same_rows(registry.QUERIES[name](spark, sf_dir), duck, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
