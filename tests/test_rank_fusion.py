"""Lists by length take numbers into their joins, and only one list is ranked where the other has all its rows."""

import pytest

from conftest import SF
from loam.plans import all_queries


@pytest.mark.parametrize("name", ["rerank_average", "fuse_weighted_sum", "ensemble_rerank"])
def test_matches_are_found_and_ranked_once(spark, name):
    plan = all_queries()[0][name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2  # the words of the documents and of the queries, once each
