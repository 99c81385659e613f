"""The registered queries on the small tables: against their SQL where there is some, else that they give rows."""

import pytest
from compare import assert_same, connect
from loomfield.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, tiny, name):
    assert_same(QUERIES[name](spark, tiny), connect(tiny).sql(ORACLE[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, tiny, name):
    df = QUERIES[name](spark, tiny.replace("sf0.001", "sf0.01") if name.startswith("p7") else tiny)  # no passage is in the smallest tables
    assert df.columns and df.count() > 0
