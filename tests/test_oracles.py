"""Every registered query against its SQL, at the smallest scale."""

import pytest

from meridia.plans.queries import ORACLES, QUERIES
from tests.oracle import connection, same

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DIR)
    if name in ORACLES:
        assert same(df, ORACLES[name], con) is None
    else:
        assert df.count() > 0


def test_filters_and_columns_reach_the_scan(spark, capsys):
    QUERIES["semantic_topk"](spark, DIR).explain("formatted")
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject" in plan and "In(label, [1,2,3])" in plan


def test_entry_point_imports():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
