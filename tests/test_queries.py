"""Every query of the library against DuckDB; those without SQL run and give rows."""

import pytest
from oracle import DATA, assert_same

from foliospark.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLES:
        assert_same(df, ORACLES[name])
    else:
        assert df.count() > 0


def test_entry_point_without_optional_package(spark, monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "foliospark.llm", None)
    import __spark_entry__ as entry

    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)
    assert entry.entry(spark).count() > 0
