"""Each query without models against its SQL, on the smallest tables."""

import pytest

from skeinframe import plans
from tests.conftest import DATA, rows_of

NAMES = sorted(plans.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, duck, name):
    got, want = plans.queries()[name](spark, DATA).toPandas(), duck.execute(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry_has_all_and_runs(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
