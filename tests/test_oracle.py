"""Every query against its SQL twin on the smallest tables."""

import pytest
from compare import difference

from cueweave.plans.oracle import ORACLE
from cueweave.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_every_query_has_a_twin():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, name):
    assert difference(QUERIES[name](spark, FOLDER), ORACLE[name], FOLDER) is None


def test_entry(spark):
    import __spark_entry__ as entry

    frame = entry.entry(spark)
    assert frame.columns == ["media_id", "part", "content"]
    assert frame.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
