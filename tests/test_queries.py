"""Every registered query of the library runs; those with a SQL twin return its rows."""

import math

import pytest

from conftest import SF
from loam.plans import all_queries

QUERIES, ORACLES = all_queries()


def rows(frame):
    out = []
    for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None):
        out.append(tuple(None if x is None or isinstance(x, float) and math.isnan(x) else round(float(x), 5) if isinstance(x, (int, float)) else str(x) for x in r))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(got.columns)
        return
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert all(x == y or all(p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) < 2e-5 for p, q in zip(x, y, strict=True)) for x, y in zip(a, b, strict=True))
