import pytest

from canopy import catalog
from compare import oracle, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_oracle(spark, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    same(got, oracle(catalog.oracle_sql()[name], SF))


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry_module_imports():
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
