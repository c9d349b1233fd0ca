import pytest

from momentloom.plans import catalog
from tests.oracle import duck_rows, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    assert rows_of(catalog.QUERIES[name](spark, SF)) == duck_rows(catalog.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "j0", "j1", "start_ms", "end_ms", "natural", "text"]
