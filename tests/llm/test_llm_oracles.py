import pytest

from compare import connect, same

from sparkloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(spark, small, name):
    same(QUERIES[name](spark, small), connect(small), ORACLE_SQL[name])
