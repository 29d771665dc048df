"""Every registered query of the core against its SQL on the smallest tables; those without SQL must give rows."""

import pytest
from comparing import compare

from lodestone.plans import load_all

REGISTRY = load_all()


@pytest.mark.parametrize("name", sorted(REGISTRY.SQL))
def test_matches_sql(name, spark, duck, data):
    compare(REGISTRY.QUERIES[name](spark, data), duck.sql(REGISTRY.SQL[name]))


@pytest.mark.parametrize("name", sorted(set(REGISTRY.QUERIES) - set(REGISTRY.SQL)))
def test_gives_rows(name, spark, data):
    assert REGISTRY.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
