import pytest
from compare import duck_rows, spark_rows

from leafmill.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, sf_dir, name):
    assert spark_rows(catalogue.queries()[name](spark, sf_dir)) == duck_rows(catalogue.oracle_sql()[name], sf_dir)
