import pytest

from keyloom.plans import queries
from oracle import same_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_matches_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, SF), queries.SQL[name], SF)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
