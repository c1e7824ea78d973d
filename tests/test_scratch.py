"""Tables of operators leave the shared folder with the scope they were made in."""

import os

import pytest

from skeinframe import plans
from skeinframe.operators import tables
from tests.conftest import DATA


def left(spark):
    folder = tables.shared_dir(spark).removeprefix("file://") + "/skeinframe"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_nothing_is_left_behind(spark):
    before = left(spark)
    with tables.scratch(spark):
        for name in ("components", "retired_doubles", "titles_with_all", "hierarchy_climb", "weekly_pick"):
            assert plans.queries()[name](spark, DATA).count() > 0
        assert left(spark) - before
    assert left(spark) == before


def test_nor_after_an_error(spark):
    before = left(spark)
    with pytest.raises(RuntimeError), tables.scratch(spark):
        tables.durable(spark.range(3), "some")
        raise RuntimeError
    assert left(spark) == before
