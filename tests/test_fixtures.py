import math

import duckdb
import pytest

from lectern.plans.fixtures import FIXTURES


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", FIXTURES)
def test_fixture(spark, name):
    got = FIXTURES[name].apply(spark)
    cursor = duckdb.connect().execute(FIXTURES[name].sql())
    assert {c[0] for c in cursor.description} == set(got.columns)
    key = lambda r: repr(tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in map(plain, r)))
    want = sorted(map(key, cursor.fetchall()))
    assert want and sorted(map(key, got.select(*[c[0] for c in cursor.description]).collect())) == want
