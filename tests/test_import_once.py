"""What the import reads for one of its tables."""

import os

import pytest

from tramline.plans import schedule

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize(("name", "most"), [("route_stop_segments", 2), ("stop_places", 2), ("route_pattern_stops", 2), ("route_patterns", 4)])
def test_stop_times_are_followed_once(spark, name, most):
    """Line items are the feed's trips and its stop times; lines are drawn beside the patterns that they belong to."""
    plan = schedule.imported(spark, DATA)[name]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") <= most, plan
