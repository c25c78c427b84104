import pytest
from brute import BRUTE
from oracle import _value, check, connect

from palaver.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        check(df, con, ORACLES[name])
        return
    shown = lambda rows: sorted(tuple(map(_value, r)) for r in rows)
    got, want = shown(df.collect()), shown(BRUTE[name](spark, SF))
    assert got == want and want


def test_every_query_is_compared():
    assert set(ORACLES) | set(BRUTE) == set(QUERIES) and not set(ORACLES) & set(BRUTE)
