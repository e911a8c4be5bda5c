import pytest
from oracle import compare

from graphloom.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_against_sql(spark, name):
    compare(Q.QUERIES[name](spark, SF), Q.ORACLE_SQL[name], SF)
