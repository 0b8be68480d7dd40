import pytest
from compare import difference
from pagewright.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_oracle(spark, sf_dir, name):
    assert difference(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name], sf_dir) is None
