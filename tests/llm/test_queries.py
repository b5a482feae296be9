"""Registered queries against SQL where SQL can say them."""

import pytest

from tessera.llm import queries as q
from tools.check_oracles import differences, tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_equals_oracle(spark, name):
    got = q.QUERIES[name](spark, SF).toPandas()
    assert differences(got, tables(SF).execute(q.ORACLES[name]).df()) == ""


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in q.QUERIES) == list(range(1, 14))


def test_chat_plan_has_no_python(spark):
    plan = q.QUERIES["op7_chat_format"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
