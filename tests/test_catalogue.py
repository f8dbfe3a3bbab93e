"""Each query against its SQL on the small tables."""

import pytest

from quarryline.plans.catalogue import ORACLES, QUERIES


def canon(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, spark, duck, sf):
    got = QUERIES[name](spark, sf)
    want = duck.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert canon(got.collect(), got.columns) == canon(want.fetchall(), names)
