"""Operators that SQL can express, against their SQL."""

import pytest

from compare import difference
from cueweave.llm.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, name):
    assert difference(QUERIES[name](spark, SMALL), ORACLE[name], SMALL) is None
