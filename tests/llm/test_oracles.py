"""Queries that SQL can state, against it."""

import pytest
from test_catalogue import canon

from quarryline.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, duck, sf):
    got = QUERIES[name](spark, sf)
    want = duck.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert canon(got.collect(), got.columns) == canon(want.fetchall(), names)
