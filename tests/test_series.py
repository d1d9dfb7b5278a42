import pytest
from compare import same

import __spark_entry__ as entry
from oriel.plans import queries as series

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(series.ORACLES))
def test_query_equals_its_sql(spark, name):
    same(series.QUERIES[name](spark, SF), series.ORACLES[name], SF)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
