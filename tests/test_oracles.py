import pytest

from mosaiq.catalog import ORACLES, QUERIES


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(same, name):
    same(QUERIES[name], ORACLES[name])
