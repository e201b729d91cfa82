"""The registered queries, against SQL where there is some."""

import compare
import odd
import pytest

import __spark_entry__ as contract
from panelforge.llm import queries


def test_all_operators_are_registered():
    names = sorted(contract.queries(), key=len)
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    got = contract.queries()[name](spark, odd.SF).toPandas()
    wanted = compare.connect(odd.SF).execute(contract.oracle_sql()[name]).df()
    assert len(got) > 0
    assert compare.difference(got, wanted) is None
