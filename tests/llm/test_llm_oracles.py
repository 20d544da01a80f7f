import pytest
from oracle import same

from pulsefield.llm.oracles import ORACLES
from pulsefield.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, name):
    same(QUERIES[name], ORACLES[name], spark, sf)


def test_there_is_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13]
