import pytest

from gleaner.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_equals_sql(spark, name):
    rows, odd = compare(spark, QUERIES[name], ORACLE_SQL[name], "/root/testdata/sf0.001")
    assert not odd and rows > 0


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))
