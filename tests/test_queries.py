"""Every query that SQL can state, against that SQL on the small tables."""

import pytest

import __spark_entry__ as entry
from loomfield.plans import containers, general, survey

from compare import assert_same, connect

CORE = general.QUERIES | survey.QUERIES | containers.QUERIES
SQL = general.ORACLE | survey.ORACLE | containers.ORACLE


@pytest.fixture(scope="module")
def duck(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, tiny, duck, name):
    assert_same(CORE[name](spark, tiny), duck.sql(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_runs_without_sql(spark, tiny, name):
    """What they must give besides is tested with their operators; p2_refused finds nothing in these tables."""
    df = CORE[name](spark, tiny)
    n = df.count()
    assert df.columns and (n == 0) == (name == "p2_refused")


def test_entry(spark, tiny):
    assert entry.entry(spark).columns == ["Hhold_key", "B10_q1", "diff", "field"]
    assert set(SQL) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
