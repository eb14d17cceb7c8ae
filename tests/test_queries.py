"""Every query with SQL against DuckDB on the smallest tables."""

import pytest

from chronofold import plans

from .compare import assert_same


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    assert_same(plans.QUERIES[name](spark, sf_dir), duck, plans.ORACLES[name])


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
