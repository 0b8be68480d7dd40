import pytest
from compare import difference
from pagewright.plans import catalog


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    assert difference(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLE_SQL[name], sf_dir) is None
