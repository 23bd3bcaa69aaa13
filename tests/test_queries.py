"""Every registered query of the library's own operators runs, and equals its SQL where it has some."""

import pytest

from quire import plans
from tests import oracle
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(plans.PLANS))
def test_query(spark, con, name):
    df = plans.queries()[name](spark, SF)
    names, got = oracle.spark_rows(df)
    assert got, "no rows"
    sql = plans.oracle_sql().get(name)
    if sql:
        want_names, want = oracle.duck_rows(con, sql)
        assert names == want_names
        assert len(got) == len(want)
        assert got == want
