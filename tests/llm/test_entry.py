"""The registered queries of the subpackage: their names, and their rows against SQL twins."""

import sys

import pytest

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from oracle import DATA, assert_same  # noqa: E402

from foliospark.llm import registry  # noqa: E402


def test_one_query_for_each_operator():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    assert_same(registry.queries()[name](spark, DATA), registry.oracle_sql()[name])
