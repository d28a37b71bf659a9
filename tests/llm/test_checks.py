"""The operators' queries against their SQL, on the smallest tables."""

import pytest

from oracle_check import compare, connect
from sitelore.llm.checks import ORACLES
from sitelore.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLES)
def test_query(spark, name):
    got, want, error = compare(spark, connect(SF), SF, name, QUERIES[name], ORACLES[name])
    assert error is None, error
    assert got == want


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 1 + len(QUERIES))]
