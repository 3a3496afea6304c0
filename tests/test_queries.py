import pytest

from gleaner.plans import catalog
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_equals_sql(spark, name):
    rows, odd = compare(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF)
    assert not odd and rows > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "rank", "doc_ord", "score"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
