import pytest

from tests import oracle
from tests.conftest import SF

queries = pytest.importorskip("quire.llm.queries")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    names, got = oracle.spark_rows(queries.queries()[name](spark, SF))
    want_names, want = oracle.duck_rows(oracle.connect(SF), queries.oracle_sql()[name])
    assert names == want_names and got == want and got
